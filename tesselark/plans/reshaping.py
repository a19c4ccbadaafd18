"""Queries of the general reshaping problems (1, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import eav, hierarchy, nested, snapshots
from tesselark.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.filled_cells(table(spark, d, "claims"), table(spark, d, "claim_properties"))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table: one row per entity, one typed column per property."""
    tables = eav.NarrowTables(table(spark, d, "claims"), table(spark, d, "claim_properties"))
    return tables.wide().select("id", *(a.name for a in tables.attributes))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_rows(table(spark, d, "raw_entities"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """The flat parent table: one row per distinct record."""
    return nested.distinct_records(table(spark, d, "raw_entities")).select("line_no", "id")


def p5_statements(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of statements, down to the main snak."""
    rows = nested.entity_children(table(spark, d, "raw_entities"), ("claim",))
    return rows.select("line_no", "child_key", "pos", *(F.col("fields")[x].alias(x) for x in ("property", "value", "rank")))


def p5_sitelinks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sitelinks."""
    rows = nested.entity_children(table(spark, d, "raw_entities"), ("sitelink",))
    return rows.select("line_no", "child_key", *(F.col("fields")[x].alias(x) for x in ("site", "title", "url")))


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.forest(hierarchy.category_links(table(spark, d, "page_categories")), hierarchy.redirect_links(table(spark, d, "redirects")))


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of the forest with the name of their tree and plain names of nodes."""
    tree = hierarchy.tree_of(F.col("node"))[0]
    plain = {c: F.when(F.col(c) == "cycle", F.lit("cycle")).otherwise(hierarchy.tree_of(F.col(c))[1]) if c == "root" else hierarchy.tree_of(F.col(c))[1] for c in columns}
    return rows.select(F.when(tree == 0, "category").otherwise("redirect").alias("tree"), *(plain.get(c, F.col(c)).alias(c) for c in rows.columns))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(hierarchy.roots(*_forest(spark, d)), "node", "root")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """A shortest full path to each root."""
    rows = hierarchy.paths(*_forest(spark, d))
    path = F.array_join(F.transform("path", lambda n: hierarchy.tree_of(n)[1]), " < ")
    return _named(rows.withColumn("path", path), "node", "root")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each node."""
    return _named(hierarchy.descendants(*_forest(spark, d)), "node", "descendant")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.page_changes(table(spark, d, "page_snapshots")).select("corpus", "id", "change_kind")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    """Typed changes with the values before and after."""
    return snapshots.page_changes(table(spark, d, "page_snapshots")).select("corpus", "id", "change_kind", "title_before", "title_after")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_wide, p5_found, p5_entities, p5_statements, p5_sitelinks, p6_found, p6_paths, p6_descendants, p7_found, p7_changes)
}

_CELLS = r"""
WITH latest AS (
  SELECT * FROM claims WHERE claim_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at DESC, id DESC, property DESC, claim_rank DESC, claim_value DESC) = 1
), coded AS (
  SELECT l.id, p.property, p.datatype, l.claim_id, l.recorded_at, trim(l.claim_value) AS v,
    lower(regexp_replace(coalesce(l.claim_rank, ''), '^\s+|\s+$', '', 'g')) AS rk
  FROM latest l JOIN claim_properties p
    ON upper(p.property) = upper(regexp_replace(l.property, '^\s*([A-Za-z]+\s*:)?\s*|\s+$', '', 'g'))
  WHERE l.id <> 0
), fields AS (
  SELECT *, CASE WHEN v LIKE '{%' THEN CASE datatype WHEN 'item' THEN json_extract_string(v, '$.id') WHEN 'date' THEN json_extract_string(v, '$.time')
      WHEN 'quantity' THEN json_extract_string(v, '$.amount') ELSE coalesce(json_extract_string(v, '$.text'), v) END ELSE v END AS x,
    CASE WHEN v LIKE '{%' THEN coalesce(try_cast(json_extract_string(v, '$.precision') AS int), 11) ELSE 11 END AS prec
  FROM coded WHERE rk <> 'deprecated'
), valued AS (
  SELECT *,
    CASE datatype
      WHEN 'item' THEN 'Q' || nullif(regexp_extract(x, '^\s*([A-Za-z]+:|https?://\S+/)?[Qq]([1-9][0-9]*)\s*$', 2), '')
      WHEN 'date' THEN CASE WHEN prec >= 11 THEN cast(coalesce(
          try_cast(nullif(regexp_extract(x, '^\+?(\d{4}-\d{2}-\d{2})(T00:00:00Z?)?$', 1), '') AS date),
          try_cast(try_strptime(x, '%d %B %Y') AS date), try_cast(try_strptime(x, '%B %d, %Y') AS date)) AS varchar) END
      WHEN 'quantity' THEN CASE WHEN regexp_matches(x, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$') OR regexp_matches(x, '^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$')
          THEN cast(try_cast(replace(replace(x, ',', ''), '+', '') AS double) AS varchar) END
      ELSE nullif(regexp_replace(x, '^\s+|\s+$', '', 'g'), '') END AS cell
  FROM fields
), won AS (
  SELECT * FROM valued WHERE cell IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, property ORDER BY (rk = 'preferred') DESC, recorded_at DESC, claim_id DESC) = 1
)
"""

#: Datatypes of the listed properties, by the rule that the table of properties follows.
_DATATYPES = dict(zip("P31 P21 P27 P569 P570".split(), "item item item date date".split(), strict=True))
_DATATYPES |= dict(zip((f"P{n}" for n in range(9001, 9010)), "item date quantity quantity text item quantity text item".split(), strict=True))
_DATATYPES |= {f"P{n}": ("text", "item", "quantity", "date")[n % 4] for n in range(9100, 9148)}
_CASTS = {"quantity": "double", "date": "date"}
_COLUMNS = ", ".join(f"cast(max(CASE WHEN property = '{p}' THEN cell END) AS {_CASTS.get(t, 'varchar')}) AS {p}" for p, t in _DATATYPES.items())

_RECORDS = """
WITH kept AS (
  SELECT * FROM raw_entities QUALIFY row_number() OVER (PARTITION BY cast(id AS varchar), cast(sitelinks AS varchar), cast(claims AS varchar) ORDER BY line_no) = 1
), s AS (
  SELECT line_no, u.key AS child_key, u.value AS link FROM kept, unnest(map_entries(sitelinks)) AS t(u)
), lists AS (
  SELECT line_no, u.key AS child_key, u.value AS list FROM kept, unnest(map_entries(claims)) AS t(u)
), c AS (
  SELECT line_no, child_key, cast(i - 1 AS int) AS pos, list[i] AS claim FROM lists, unnest(range(1, len(list) + 1)) AS t(i)
)
"""

_TITLE = r"""nullif(trim(regexp_replace(split_part(nfc_normalize({0}), '#', 1), '[\s_]+', ' ', 'g')), '')"""
_CAPITAL = "upper(left({0}, 1)) || substr({0}, 2)"
_TREES = rf"""
WITH RECURSIVE raw AS (
  SELECT {_TITLE.format("title")} AS a, {_TITLE.format("redirect")} AS b FROM redirects
), links AS (
  SELECT DISTINCT 'category' AS tree, cast(id AS varchar) AS child, cast(u AS varchar) AS parent FROM page_categories, unnest(categories) AS t(u) WHERE u IS NOT NULL AND id IS NOT NULL
  UNION ALL SELECT DISTINCT 'redirect', {_CAPITAL.format("a")}, {_CAPITAL.format("b")} FROM raw WHERE a IS NOT NULL AND b IS NOT NULL
), nodes AS (
  SELECT tree, child AS node FROM links UNION SELECT tree, parent FROM links UNION SELECT 'category', cast(id AS varchar) FROM page_categories WHERE id IS NOT NULL
), above AS (
  SELECT tree, child AS node, parent AS up FROM links
  UNION SELECT a.tree, a.node, l.parent FROM above a JOIN links l ON l.tree = a.tree AND l.child = a.up
), circle AS (
  SELECT DISTINCT a.tree, a.node FROM above a JOIN above b ON b.tree = a.tree AND b.node = a.up AND b.up = b.node
  UNION SELECT tree, node FROM above WHERE node = up
), far AS (
  SELECT tree, node, node AS up, 0 AS steps FROM nodes n WHERE NOT EXISTS (FROM circle c WHERE c.tree = n.tree AND c.node = n.node)
  UNION SELECT f.tree, f.node, l.parent, f.steps + 1 FROM far f JOIN links l ON l.tree = f.tree AND l.child = f.up
)
"""

_CHANGES = rf"""
WITH clean AS (
  SELECT corpus, id, loaded_at, {_TITLE.format("title")} AS t FROM page_snapshots WHERE id <> 0
), kept AS (
  SELECT corpus, id, {_CAPITAL.format("t")} AS title FROM clean QUALIFY row_number() OVER (PARTITION BY corpus, id ORDER BY loaded_at DESC, t DESC) = 1
), dumps AS (
  SELECT corpus, lag(corpus) OVER (ORDER BY corpus) AS prior FROM (SELECT DISTINCT corpus FROM page_snapshots WHERE corpus IS NOT NULL)
), new AS (SELECT d.corpus, k.id, k.title FROM dumps d JOIN kept k ON k.corpus = d.corpus WHERE d.prior IS NOT NULL),
old AS (SELECT d.corpus, k.id, k.title FROM dumps d JOIN kept k ON k.corpus = d.prior),
both_sides AS (
  SELECT coalesce(n.corpus, o.corpus) AS corpus, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.title IS DISTINCT FROM o.title THEN 'changed' END AS change_kind,
    o.title AS title_before, n.title AS title_after
  FROM new n FULL JOIN old o ON n.corpus = o.corpus AND n.id = o.id
)
"""

SQL = {
    "p1_found": _CELLS + "SELECT id, property, claim_id FROM won",
    "p1_wide": _CELLS + f"SELECT id, {_COLUMNS} FROM won GROUP BY id",
    "p5_found": _RECORDS
    + r"""SELECT DISTINCT line_no, 'claim' AS child, child_key, pos FROM c WHERE trim(claim.mainsnak.datavalue.value) NOT IN ('', 'null')
      UNION ALL SELECT DISTINCT line_no, 'sitelink', child_key, 0 FROM s WHERE trim(link.title) <> ''""",
    "p5_entities": _RECORDS + "SELECT line_no, id FROM kept",
    "p5_statements": _RECORDS + "SELECT line_no, child_key, pos, claim.mainsnak.property AS property, claim.mainsnak.datavalue.value AS value, claim.rank AS rank FROM c WHERE claim IS NOT NULL",
    "p5_sitelinks": _RECORDS + "SELECT line_no, child_key, link.site AS site, link.title AS title, link.url AS url FROM s WHERE link IS NOT NULL",
    "p6_found": _TREES
    + """SELECT tree, node, up AS root, cast(min(steps) AS int) AS steps FROM far f WHERE NOT EXISTS (FROM links l WHERE l.tree = f.tree AND l.child = f.up) GROUP BY ALL
      UNION ALL SELECT tree, node, 'cycle', -1 FROM circle""",
    # of several shortest paths the one with the smallest next node at each step; names compare by their bytes
    "p6_paths": _TREES
    + """, way AS (
        SELECT tree, node, up AS root, cast(min(steps) AS int) AS steps FROM far f WHERE NOT EXISTS (FROM links l WHERE l.tree = f.tree AND l.child = f.up) GROUP BY ALL
      ), hop AS (
        SELECT w.tree, w.node, w.root, w.steps, min(l.parent) AS up FROM way w JOIN links l ON l.tree = w.tree AND l.child = w.node
          JOIN way a ON a.tree = w.tree AND a.node = l.parent AND a.root = w.root AND a.steps = w.steps - 1 GROUP BY ALL
      ), path AS (
        SELECT tree, node, root, steps, node AS cur, node AS path FROM way
        UNION ALL SELECT p.tree, p.node, p.root, p.steps, h.up, p.path || ' < ' || h.up FROM path p JOIN hop h ON h.tree = p.tree AND h.node = p.cur AND h.root = p.root
      )
      SELECT tree, node, root, steps, path FROM path WHERE cur = root UNION ALL SELECT tree, node, 'cycle', -1, NULL FROM circle""",
    # descendants below a node that no circle is above of; what is below may be in circles, whose turns end at 150 links
    "p6_descendants": _TREES
    + """, down AS (
        SELECT tree, parent AS top, child AS node, 1 AS steps FROM links l WHERE NOT EXISTS (FROM circle c WHERE c.tree = l.tree AND c.node = l.parent)
        UNION SELECT d.tree, d.top, l.child, d.steps + 1 FROM down d JOIN links l ON l.tree = d.tree AND l.parent = d.node WHERE d.steps < 150
      )
      SELECT tree, top AS node, node AS descendant, cast(min(steps) AS int) AS steps FROM down WHERE top <> node GROUP BY ALL""",
    "p7_found": _CHANGES + "SELECT corpus, id, change_kind FROM both_sides WHERE change_kind IS NOT NULL",
    "p7_changes": _CHANGES + "SELECT corpus, id, change_kind, title_before, title_after FROM both_sides WHERE change_kind IS NOT NULL",
}
