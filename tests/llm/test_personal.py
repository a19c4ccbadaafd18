import random

import pytest

from tesselark.llm import personal

from ..conftest import rows

FOUND = {
    "email": ["Write to a.b+c@mail.example.org now", "mailto:x_y@uni.example.edu", "a-b(at)inbox.invalid", "ab [at] desk [dot] example [dot] com", "ab AT post DOT example DOT org", "ab @ mail.example", "<AB@EXAMPLE.NET>", "Écrire : a@b.example."],
    "phone": ["Call +1 371 555 0126 now", "(403) 555-0191", "(508)5550157", "839-555-0117", "241.555.0194", "546‑555‑0185", "+12145550131", "tel:+1-233-555-0114", "020 7946 0988", "+44 20 7946 0298", "+44 (0)1632 960834", "888-555-0180 ext. 05"],
    "id_number": ["SSN 968-86-1927", "SSN: 940 12 7361", "907-05-3438 (social security)", "national ID 3206-056-3041", "tax identification number 92 031 232 863", "personal identity number 201334-6226", "passport no. S13733271", "ID-Nr. N159P49394", "identity card XH 105782 Y"],
    "address": ["at 40 Orchardside Close, Seilil 34194.", "Flat 29, 118 Heron Road, Traveick", "58C Foxhollow Crescent", "74C Gravel St..", "8 Cooper's Ave, Yip 29039", "Lindenweg 187, 62043 Woup", "Mühlenallee 233", "Kirchstraße 11", "203, rue des Tanneurs, 34736 Gousour", "P.O. Box 581, Yeaklou 91531", "Postfach 1234", "140 Juniper Terrace\nRabiack\n25399"],
    "name": ["by Petra Stenström there", "Dr. Hana K. Carvovic", "Gustav van der Dravmann", "Katrin al-Jurraro", "Wendell Jurrström-Dravmore", "Tarnaro, Elena on", "LEOPOLD QUILLHOLT", "Yusuf von Corbsworth (1746–1970)", "Вера Бразова", "Leila de la Thornmann"],
}
NOTHING = [
    "The handle @keavobraim was never claimed.", "It bears the accession number 915-12-0481.", "ISBN 978-0-865-27941-9.", "NGC 4757 and again as 5174-026.", "The 1898-1911 volume has 121 plates.",
    "Its grid reference is 79.3893 N, 47.1461 E.", "Version 4.49.367 fixed the index.", "1234567890 1234567890 1234567890", "The population rose from 447,553 to 1,226,032.", "Juniper Road runs north from Nakoum.",
    "Ulrich Harbour is a landmark.", "Kofi Bridge is a landmark.", "The Carvanova Prize was founded.", "The Dravovic family kept 71 of them.", "Lake Dratroukoun and Mount Klibreack mark the border.",
    "Der Marktplatz von Prudem wurde 1661 errichtet", "The park was called the verdict road in 1555.", "Doi 10.5841/zaizir.3918 resolves to nothing.", "Trains leave at 10:15, 11:45 and 13:05.", "1,000.50 3.14e-10 0x1F", "met at noon dot com", "Hull number 382-4", "", "   ",
]


@pytest.mark.parametrize("kind", FOUND)
def test_found(kind):
    finder = personal.Finder()
    for text in FOUND[kind]:
        assert {s[2] for s in finder.spans(text)} == {kind}, text


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert personal.Finder().spans(text) == []


def test_redaction_keeps_the_rest():
    text = "It was noticed by Zoltan Tarnanova, who lives at Flat 15, 74 Weaver Road, Bailoukil; call +44 20 7946 0922 or z@x.example, thanks.\n\nSSN: 949 40 8012; phone 020 7946 0988."
    want = "It was noticed by [NAME], who lives at [ADDRESS]; call [PHONE] or [EMAIL], thanks.\n\nSSN: [ID_NUMBER]; phone [PHONE]."
    assert personal.Finder().redact(text)[0] == want
    assert personal.Finder().redact(want)[0] == want


def test_finds_end_where_the_number_or_name_ends():
    street = "12, rue de la " + "Longue" * 9
    for text in ("Apartado de correos 123456", "Apartado de correos no. 1234", "Post Office Box no. 654321", "Boîte postale no. 123456", street):
        assert personal.Finder().redact(f"Write to {text}; thanks")[0] == "Write to [ADDRESS]; thanks", text


def test_names_with_given_names_of_no_list():
    finder = personal.Finder()
    for name, text in {
        "Thorvald Kellström": "found by {} in 1911", "Wanjiru Kamau": "Dr. {} spoke", "Ngozi Adeyemi": "It was {} (born 1950) who", "Kwabena J. Osei": "{} was born there", "Aiko Tanaka": "{} (1901–1980) wrote",
        "Борислав Тарнов": "Автор {} писал", "Jurrwick, Sipho": "Editors:\n{}\nand others", "Solveig van der Dravmann": "with {}, who",
    }.items():
        assert name.split()[0].lower() not in personal.GIVEN_NAMES and finder.redact(text.format(name))[0] == text.format("[NAME]"), name
    for text in ("The Dravovic family", "In Marlridge they met", "Upper Marshgate is", "Near Lake Kellström", "Sir Edmund Bridge", "The Harbour was born of need", "Thorvald Kellström Prize"):
        assert finder.spans(text) == [], text


def test_finds_are_as_long_as_they_are():
    """Beyond any window: words of any length around an anchor."""
    finder = personal.Finder()
    long = "b" * 300
    for text in (f"{long}@{long}.example", "x AT " + "y DOT " * 40 + "example", f"{long}(at)desk.example", f"x AT {long} DOT example"):
        assert finder.redact(f"write {text} now")[0] == "write [EMAIL] now", text[:40]
    for text in (f"12 Q{long} W{long} Street", f"Flat 3, 12 Q{long} Road"):
        assert finder.redact(f"at {text} now")[0] == "at [ADDRESS] now", text[:40]
    for text in (f"Petra X{long} Y{long}-Kellström", f"X{long}beck, Maria"):
        assert "[NAME]" in finder.redact(f"by {text};")[0], text[:40]
    assert finder.redact("Tel: 040 123456, phone no. 11 22 33 44 55, fax 12-345-678")[0] == "Tel: [PHONE], phone no. [PHONE], fax [PHONE]"
    assert finder.spans("1 2 3 4 5 6 7 8 9 0 " * 20_000) == []
    assert finder.spans("tel 12, phones 123456 and hotel 123456") == []


def test_common_and_cued_names():
    finder = personal.Finder()
    for name in ("Giulia Rossi", "Emma Johnson", "Mohammed Khan", "Sarah Connor", "Liam Murphy", "Wei Zhang", "Yuki Tanaka", "Olivia Brown"):
        assert finder.redact(f"Then {name} came.")[0] == "Then [NAME] came.", name
    assert finder.redact("It was Kwame Mensah who came; Thandiwe Dube said so.")[0] == "It was Kwame Mensah who came; [NAME] said so."


def test_names_are_learned_from_the_corpus(spark):
    """A given name of no list that stands beside cues elsewhere is an anchor where it has none."""
    cues = ["Dr. Quorvin Tal spoke", "Quorvin Besk (born 1911) was", "the late Quorvin Tal said so", "Ms. Ozrelle Pim came", "Ozrelle Pim was born here"]
    plain = ["a gift of Quorvin Hask to all", "a gift of Ozrelle Pim to all", "the Quorvin Bridge", None, ""]
    # a word before the names of places, some of which end like family names
    places = [f"the Dorp {x} lies" for x in ("Karlström", "Vinsky", "Walberg")] + [f"the Dorp Bral{i}um lies" for i in range(40)]
    assert rows(personal.learned_names(spark.createDataFrame(list(enumerate(places)), "doc_id long, text string"))) == []
    df = spark.createDataFrame(list(enumerate(cues + plain)), "doc_id long, text string")
    learned = personal.learned_names(df)
    assert rows(learned) == [("quorvin", 2, 3)]  # the other stands with one family name
    got = rows(personal.found_kinds(df))
    assert got == [(i, "name") for i in (0, 1, 2, 3, 4, 5)]
    assert rows(personal.found_kinds(df, learn=False)) == [(i, "name") for i in range(5)]
    listed = spark.createDataFrame([("Ozrelle",), (None,)], "name string")
    assert (6, "name") in rows(personal.found_kinds(df, given_names=listed))


def test_held_out_names(spark):
    """Names that no list holds, in a corpus where a third of the mentions has a cue: nine in ten must be found."""
    r = random.Random(5)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "vu", "ze", "dri", "gla"]
    given = sorted({"".join(r.sample(syllables, 2)).capitalize() + "n" for _ in range(40)})
    family = sorted({"".join(r.sample(syllables, 3)).capitalize() + "k" for _ in range(300)})
    plain, cued = ["We owe this to {} and others.", "a note that {} left there", "the house of {} stood"], ["Dr. {} came.", "It was {} (born 1920).", "Later {} wrote it."]
    data = [(i, r.choice(cued if r.random() < 0.33 else plain).format(f"{r.choice(given)} {r.choice(family)}")) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert not {g.lower() for g in given} & set(personal.GIVEN_NAMES)
    assert personal.found_kinds(df, given_names=[]).count() >= 0.9 * len(data)
    decoys = spark.createDataFrame([(i, f"the {r.choice(given)} {r.choice(['Bridge', 'Prize', 'Harbour'])} stood") for i in range(200)], "doc_id long, text string")
    assert personal.found_kinds(df.unionByName(decoys.withColumn("doc_id", decoys.doc_id + 5000))).where("doc_id >= 5000").count() == 0


def test_columns(spark):
    long = "word " * 60_000 + "a@b.example" + " word" * 60_000
    df = spark.createDataFrame([(1, "Call 839-555-0117", "x"), (2, None, "x"), (3, "", "x"), (1, "Call 839-555-0117", "x"), (4, long, "x"), (None, "a@b.example", "x")], "doc_id long, text string, kind string")
    assert rows(personal.found_kinds(df)) == sorted([(1, "phone"), (4, "email"), (None, "email")], key=repr)
    assert rows(personal.found_kinds(df.where("false"))) == []
    got = {r.doc_id: r for r in personal.redacted(df).collect()}
    assert got[2].text is None and got[3].text == "" and got[1].text == "Call [PHONE]" and got[4].text == long.replace("a@b.example", "[EMAIL]")
