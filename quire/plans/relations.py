"""The relations that the queries bind the given tables to, as DataFrames and as SQL of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.manifest import CROP
from quire.operators.ranks import dealt
from quire.sources.readers import LINES_PER_PAGE, text_lines, text_words


class Tables:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def lines(self) -> DataFrame:
        return text_lines(self["documents"])

    @property
    def words(self) -> DataFrame:
        return text_words(self.lines)

    @property
    def pages_of(self) -> DataFrame:
        """vdoc, source_id, page: pages by their source, without looking at more than a text's line feeds."""
        docs = self["documents"]
        n = F.size(F.split("text", "\n", -1))
        return docs.select(F.col("source").alias("vdoc"), F.col("doc_id").alias("source_id"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / LINES_PER_PAGE).cast("int"))).alias("page"))

    @property
    def manifest(self) -> DataFrame:
        from quire.operators.manifest import seed_manifest

        m = seed_manifest(self.pages_of)
        return m.withColumns({"native_rotation": (F.col("source_id") % 4 * 90).cast("int"), "fx0": F.lit(0.0), "fy0": F.lit(0.0), "fx1": (500 + F.col("source_id") % 100).cast("double"), "fy1": F.lit(800.0)})

    @property
    def outline(self) -> DataFrame:
        lines = self.lines
        return lines.select(F.col("doc_id"), F.col("ln").cast("long").alias("seq"), (1 + F.length("line") % 6).alias("level"), F.substring("line", 1, 40).alias("title"), F.col("page").cast("long").alias("page"))

    @property
    def links(self) -> DataFrame:
        n = F.length("line")
        rows = self.lines.withColumn("pages", F.max("page").over(Window.partitionBy("doc_id")) + 1)
        kind = F.when(n % 3 == 0, "goto").when(n % 3 == 1, "named").otherwise("uri")
        target = (7 * n) % F.col("pages")
        return rows.select(F.col("doc_id").alias("source_id"), "page", F.col("ln").alias("link_no"), kind.alias("kind"), F.when(n % 3 == 0, target).alias("target_page"), F.when(n % 3 == 1, F.concat(F.lit("d"), target.cast("string"))).alias("dest"), F.when(n % 3 == 2, F.concat(F.lit("u:"), n.cast("string"))).alias("uri"), n.alias("w"))

    @property
    def dests(self) -> DataFrame:
        """Names of every second page."""
        return self.pages_of.where("page % 2 = 0").select("source_id", F.concat(F.lit("d"), F.col("page").cast("string")).alias("name"), "page")

    @property
    def bars(self) -> DataFrame:
        li = dealt(self["lineitem"], "l_orderkey")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        z = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
        kind = F.when(F.col("l_returnflag") == "A", "highlight").when(F.col("l_returnflag") == "N", "underline").otherwise("ink")
        x0 = (F.col("l_partkey") % 100).cast("long")
        return li.select(F.col("l_orderkey").alias("page"), z.cast("long").alias("z"), kind.alias("kind"), F.col("l_linestatus").alias("color"), F.col("l_linenumber").cast("long").alias("line"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"), (F.col("l_suppkey") % 3 == 0).alias("own"))

    @property
    def events(self) -> DataFrame:
        e = self["events"]
        return e.select(F.col("user_id").alias("doc"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), "value", (F.col("event_id") % 2 == 0).alias("auto_repeat"), F.col("event_id").alias("delta"))

    @property
    def points(self) -> DataFrame:
        e = self["events"]
        return e.select("event_id", F.col("user_id").alias("page"), F.floor(F.col("value")).cast("long").alias("x"), (F.col("event_id") % 7 + 1).alias("line"))

    @property
    def terms(self) -> DataFrame:
        first = F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))
        return self["benchmark"].select(first.alias("term")).where(F.length("term") >= 4).distinct()

    @property
    def fields(self) -> DataFrame:
        o = self["orders"]
        return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit("status").alias("name"), F.lit("text").alias("type"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("name"), F.lit("combobox").alias("type"), F.col("o_orderpriority").alias("value")))).alias("f")).select("doc_id", "f.*")


SQL: dict[str, str] = {
    "L": """SELECT doc_id, ln, ln // 40 AS page, ln % 40 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents)""",
    "W0": """SELECT doc_id, ln, page, line_no, line, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM L""",
    "W1": """SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0 FROM W0""",
    "W": """SELECT doc_id, ln, page, line_no, row_number() OVER (PARTITION BY doc_id, ln ORDER BY i) - 1 AS word_no, word, c0, c0 + length(word) AS c1 FROM W1 WHERE word <> ''""",
    "PG": """SELECT source AS vdoc, doc_id AS source_id, unnest(range((len(string_split(text, chr(10))) - 1) // 40 + 1)) AS page FROM documents""",
    "M": """SELECT vdoc, row_number() OVER (PARTITION BY vdoc ORDER BY source_id, page) - 1 AS pos, source_id, page, (source_id % 4 * 90)::BIGINT AS native_rotation, 0.0::DOUBLE AS fx0, 0.0::DOUBLE AS fy0, (500 + source_id % 100)::DOUBLE AS fx1, 800.0::DOUBLE AS fy1 FROM PG""",
    "T": """SELECT doc_id, ln AS seq, 1 + length(line) % 6 AS level, substring(line, 1, 40) AS title, page FROM L""",
    "K": """SELECT doc_id AS source_id, page, ln AS link_no, CASE n % 3 WHEN 0 THEN 'goto' WHEN 1 THEN 'named' ELSE 'uri' END AS kind, CASE WHEN n % 3 = 0 THEN (7 * n) % pages END AS target_page, CASE WHEN n % 3 = 1 THEN 'd' || ((7 * n) % pages)::VARCHAR END AS dest, CASE WHEN n % 3 = 2 THEN 'u:' || n::VARCHAR END AS uri, n AS w FROM (SELECT *, length(line) AS n, max(page) OVER (PARTITION BY doc_id) + 1 AS pages FROM L)""",
    "DEST": """SELECT source_id, 'd' || page::VARCHAR AS name, page FROM PG WHERE page % 2 = 0""",
    "KR": """SELECT K.source_id, K.page, K.link_no, K.kind, CASE WHEN K.kind = 'named' THEN DEST.page ELSE K.target_page END AS target_page FROM K LEFT JOIN DEST ON K.source_id = DEST.source_id AND K.dest = DEST.name""",
    "B": """SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS z, CASE l_returnflag WHEN 'A' THEN 'highlight' WHEN 'N' THEN 'underline' ELSE 'ink' END AS kind, l_linestatus AS color, l_linenumber::BIGINT AS line, (l_partkey % 100)::BIGINT AS x0, (l_partkey % 100 + l_quantity::BIGINT)::BIGINT AS x1, l_suppkey % 3 = 0 AS own FROM lineitem""",
    "E": """SELECT user_id AS doc, event_id, ts, event_type AS op, value, event_id % 2 = 0 AS auto_repeat, event_id AS delta FROM events""",
    "P": """SELECT event_id, user_id AS page, floor(value)::BIGINT AS x, event_id % 7 + 1 AS line FROM events""",
    "Q": """SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS term FROM benchmark WHERE length(regexp_extract(text, '^([A-Za-z]+)', 1)) >= 4""",
    "F": """SELECT o_orderkey AS doc_id, 'status' AS name, 'text' AS type, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', 'combobox', o_orderpriority FROM orders""",
}
_USES = {"L": [], "W0": ["L"], "W1": ["W0"], "W": ["W1"], "PG": [], "M": ["PG"], "T": ["L"], "K": ["L"], "DEST": ["PG"], "KR": ["K", "DEST"], "B": [], "E": [], "P": [], "Q": [], "F": []}


def with_relations(names: str, body: str) -> str:
    """SQL with the relations that it names, and those that they are made of, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for used in _USES[name]:
            add(used)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ("RECURSIVE " if "RECURSIVE" in body[:30] else "") + ", ".join([*ctes, body.lstrip()[5:].removeprefix("RECURSIVE ")])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
