"""Words, numbers and dates in text, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

#: What stands for sequences that mean the same.
NUM, PERCENT, DATE = "_num_", "_percent_", "_date_"
_MONTHS = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
# word borders of ASCII words, as in RE2; Java's own would also count other letters
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def words(text: Column) -> Column:
    """Words of ASCII letters, digits, underscores and apostrophes, without apostrophes at the ends; empty ones dropped."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_']+)"), F.lit(1))
    return F.filter(F.transform(found, lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")


def normal_word(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit("'"))


def normal_article(text: Column) -> Column:
    """Lower case, then numbers, percentages and dates by one token each."""
    text = F.regexp_replace(F.lower(text), _B + r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?" + _B, NUM)
    text = F.regexp_replace(text, NUM + "%", PERCENT)
    return F.regexp_replace(text, f"(?i){_B}(?:{NUM} (?:{_MONTHS},? )?{NUM}|{_MONTHS} {NUM},? {NUM}){_B}", DATE)


def xml_tags(text: Column) -> Column:
    """Openings of tags that are left in a text."""
    return F.regexp_extract_all(text, F.lit("(<[a-z][a-z0-9]+)"), F.lit(1))


def pairs(tokens: Column) -> Column:
    """Adjacent tokens as structs of ``left`` and ``right``. The tokens are zipped with themselves, one further: a lambda
    that looked them up by position would work them out again for every token."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def prefixes(phrase: Column) -> Column:
    """All prefixes of a phrase that end with a word, itself included."""
    parts = F.split(phrase, " ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " "))


class PhraseTree:
    """A dictionary of n-grams as a tree of word numbers: hashed pairs of a node and the next word lead to a node. Tokens of
    all texts of a batch grow together, one word a round, so that rounds are as many as the longest n-gram has words."""

    def __init__(self, phrases: Iterable[str]):
        chains = [p.split(" ") for p in phrases]
        self.words = pa.array(sorted({w for c in chains for w in c}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.width = max(1, len(number))
        nodes: dict[int, int] = {}  # node * width + word -> node; the nodes of single words come first
        whole: dict[int, bool] = {i: True for i in range(self.width)}
        for c in sorted(chains, key=len):
            at = number[c[0]]
            for w in c[1:]:
                at = nodes.setdefault(at * self.width + number[w], self.width + len(nodes))
                whole.setdefault(at, False)
            whole[at] = True
        # a token only grows by known phrases, so that what lies behind an unknown one is out of reach
        live = {k: v for k, v in nodes.items() if whole[v]}
        self.keys = np.array(sorted(live), np.int64)
        self.next = np.array([live[k] for k in self.keys.tolist()], np.int64)

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node behind each node by a word (-1: none)."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node * self.width + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((word >= 0) & (self.keys[at] == key), self.next[at], -1)

    def tokens(self, words: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Tokens of texts given as words one after another with the offsets of the texts: the same of the tokens."""
        n = len(words)
        number = pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.words) else np.full(n, -1)
        end_of = np.repeat(offsets[1:], np.diff(offsets))  # where the text of each word ends
        length, live, node = np.ones(n, np.int64), np.flatnonzero(number >= 0), number[number >= 0]
        while len(live):  # how many words a token that starts at each place has
            behind = live + length[live]
            inside = behind < end_of[live]
            live, node, behind = live[inside], node[inside], behind[inside]
            node = self.step(node, number[behind])
            live, node = live[node >= 0], node[node >= 0]
            length[live] += 1
        # tokens start at text starts and behind tokens: places are reached by doubling jumps from all text starts
        target = np.append(np.minimum(np.arange(n) + length, end_of), n)
        reached = np.zeros(n + 1, bool)
        reached[offsets[:-1][np.diff(offsets) > 0]] = True
        # a jump that ends a text lands on the start of the next one, which is reached anyway
        while True:
            new = np.zeros(n + 1, bool)
            new[target[np.flatnonzero(reached)]] = True
            new |= reached
            if (new == reached).all():
                break
            reached, target = new, target[target]
        start = np.flatnonzero(reached[:n])
        if (length[start] == 1).all():
            out = words
        else:
            size = length[start]
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, n).astype(np.int32)), words)
            out = pc.binary_join(lists, " ") if (size > 0).all() else lists
        return out, np.searchsorted(start, offsets)


def ngram_tokens(spark: SparkSession, dictionary: list[str], bound: int = 5_000_000) -> Callable[[Column], Column]:
    """A tokenizer that joins adjacent words to the longest n-gram whose prefixes are all known. It takes an array of
    words; the dictionary is broadcast to every worker and built into a tree once per worker, so its size is bounded."""
    if len(dictionary) > bound:
        raise ValueError(f"a dictionary of more than {bound} n-grams is too large for the workers")
    shared = spark.sparkContext.broadcast(PhraseTree(dictionary))

    @arrow_udf(ArrayType(StringType()))
    def tokens(words: pa.Array) -> pa.Array:
        lists = words.fill_null([]) if words.null_count else words
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
        got, offsets = shared.value.tokens(flat, np.append(0, np.cumsum(sizes)))
        out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), got, mask=words.is_null() if words.null_count else None)
        return out

    return tokens
