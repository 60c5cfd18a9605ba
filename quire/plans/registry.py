"""The registered queries of the reference's operators: each binds an operator to whole tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import links as K
from quire.operators import manifest as M
from quire.operators import marks as A
from quire.operators import metadata as D
from quire.operators import ranges as P
from quire.operators import search as Q
from quire.functions import scalars as S
from quire.plans.relations import Tables, with_relations
from quire.sources import readers as R
from quire.sources import sinks as W
from quire.streaming import history as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and fractions as double, so that both engines' types are the same."""
    wide = {T.IntegerType: "long", T.ShortType: "long", T.ByteType: "long", T.FloatType: "double"}
    return df.select(*[F.col(f"`{f.name}`").cast(wide[type(f.dataType)]).alias(f.name) if type(f.dataType) in wide else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, uses: str = "", sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(build(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = with_relations(uses, sql)
        return build

    return register


MCOLS = ["vdoc", "pos", "source_id", "page"]


def picked(m: DataFrame, k: int = 5, r: int = 2) -> DataFrame:
    return m.where(F.col("pos") % k == r).select("vdoc", "pos")


# ---- sources and sinks


@query("s1_read_sources", "", "SELECT doc_id AS source_id, source || '/' || doc_id::VARCHAR AS path, length(text) AS size FROM documents")
def _(t):
    return R.read_sources(t.spark, f"{t.dir}/documents.parquet")


@query("s2_text_lines", "L", "SELECT doc_id, ln, page, line_no, line FROM L")
def _(t):
    return t.lines


@query("s3_text_words", "W", "SELECT doc_id, ln, page, line_no, word_no, word, c0, c1 FROM W")
def _(t):
    return t.words


HREFS = """SELECT page_id, i - 1 AS link_no, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""


@query("s4_read_links", "", f"SELECT *, CASE WHEN href LIKE '#%' THEN 'page' WHEN href LIKE '/%' THEN 'internal' ELSE 'uri' END AS kind FROM ({HREFS})")
def _(t):
    return R.read_links(t["pages"])


INFO = """SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages"""


@query("s5_read_info", "", f"SELECT page_id, title, coalesce(url, '') AS creator, '' AS author, lang AS subject, 9::BIGINT AS n FROM ({INFO})")
def _(t):
    i = R.read_info(t["pages"])
    return i.select("page_id", *[F.col("info")[k].alias(k) for k in ("title", "creator", "author", "subject")], F.size("info").alias("n"))


def authored(t: Tables) -> DataFrame:
    author = F.when(F.col("z") % 3 == 0, "me").when(F.col("z") % 3 == 1, " other ")
    return t.bars.withColumns({"author": author, "contents": F.when(F.col("z") % 2 == 0, F.col("color"))})


AUTHORED = "SELECT *, CASE z % 3 WHEN 0 THEN 'me' WHEN 1 THEN ' other ' END AS author, CASE WHEN z % 2 = 0 THEN color END AS contents FROM B"


@query("s6_read_marks", "B", f"SELECT page, z, kind, color FROM ({AUTHORED}) WHERE author = 'me' AND kind IN ('highlight', 'underline', 'strikeout')")
def _(t):
    return R.read_marks(authored(t), "me", P.OWN_MARKUP).select("page", "z", "kind", "color")


@query("s7_read_foreign", "B", f"SELECT page, z, kind, trim(coalesce(author, '')) AS author, coalesce(contents, '') AS contents FROM ({AUTHORED}) WHERE author IS NULL OR trim(author) <> 'me'")
def _(t):
    return R.read_foreign(authored(t), "me").select("page", "z", "kind", "author", "contents")


@query("s8_read_fields", "M", """SELECT m.vdoc, m.pos, w.name, w.type, w.value FROM (
    SELECT source_id, page, 'f' || (source_id % 3)::VARCHAR AS name, CASE source_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'button' ELSE 'combobox' END AS type, 'v' AS value FROM M WHERE page % 2 = 0
    UNION ALL SELECT source_id, page, CASE WHEN source_id % 2 = 0 THEN 'new' ELSE '' END, 'text', NULL FROM M WHERE page % 2 = 1) w JOIN M m USING (source_id, page) WHERE w.name <> '' AND w.type <> 'button'""")
def _(t):
    m = t.manifest
    kind = F.when(F.col("source_id") % 4 == 0, "text").when(F.col("source_id") % 4 == 1, "checkbox").when(F.col("source_id") % 4 == 2, "button").otherwise("combobox")
    stored = m.where("page % 2 = 0").select("source_id", "page", F.concat(F.lit("f"), (F.col("source_id") % 3).cast("string")).alias("name"), kind.alias("type"), F.lit("v").alias("value"))
    placed = m.where("page % 2 = 1").select("source_id", "page", F.when(F.col("source_id") % 2 == 0, "new").otherwise("").alias("name"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("value"))
    return R.read_fields(stored, placed, m)


#: Every fifth record is cut short, every seventh is no record at all.
@query("s9_append_sources", "", f"SELECT page_id, link_no, CASE WHEN link_no % 5 <> 3 AND link_no % 7 <> 4 THEN href END AS href, link_no % 5 <> 3 AND link_no % 7 <> 4 AS ok FROM ({HREFS})")
def _(t):
    links = R.read_links(t["pages"])
    record = F.when(F.col("link_no") % 7 == 4, "no record").when(F.col("link_no") % 5 == 3, F.expr("substring(r, 1, length(r) - 1)")).otherwise(F.col("r"))
    batch = links.withColumn("r", F.to_json(F.struct(F.col("href").alias("path")))).select("page_id", "link_no", record.alias("record"))
    ok, bad = R.append_sources(batch, "path string")
    return ok.select("page_id", "link_no", F.col("path").alias("href"), F.lit(True).alias("ok")).unionByName(bad.select("page_id", "link_no", F.lit(None).cast("string").alias("href"), F.lit(False).alias("ok")))


@query("s11_export_pages", "M", "SELECT vdoc, row_number() OVER (PARTITION BY vdoc ORDER BY pos) - 1 AS pos, source_id, page, pos AS origin FROM M WHERE pos % 5 = 2")
def _(t):
    m, path = t.manifest, W.shared_path(t.spark, "extract")
    W.export_pages(m, picked(m).union(picked(m)), path)
    return W.read_committed(t.spark, path).select(*MCOLS, "origin")


@query("s12_page_labels", "M", """SELECT vdoc, pos, CASE WHEN count(*) OVER (PARTITION BY vdoc) = 1 THEN '' ELSE lpad((pos + 1)::VARCHAR, length(pages::VARCHAR)::INT, '0') END AS label
    FROM (SELECT *, max(pos) OVER (PARTITION BY vdoc) + 1 AS pages FROM M) WHERE pos % 5 = 2""")
def _(t):
    m = t.manifest
    return W.page_labels(m, picked(m))


@query("s13_flatten", "W", """SELECT doc_id, page, string_agg(part, ' ' ORDER BY layer, ln, word_no) AS content FROM (
    SELECT doc_id, page, 0 AS layer, ln, word_no, word AS part FROM W
    UNION ALL SELECT doc_id, 0, 1, z, 0, note FROM (SELECT doc_id, 1 AS z, 'note on ' || lang AS note FROM documents)
    UNION ALL SELECT doc_id, 0, 2, 0, 0, source FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id, page""")
def _(t):
    d = t["documents"]
    marks = d.select("doc_id", F.lit(0).alias("page"), F.lit(1).alias("z"), F.concat(F.lit("note on "), "lang").alias("note"))
    fills = d.select("doc_id", F.lit(0).alias("page"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("value"))
    return W.flatten(R.line_texts(t.lines), marks, fills)


@query("s14_size_report", "L", """SELECT source AS vdoc, sum(octet_length(line::BLOB))::BIGINT AS bytes_before, sum(CASE WHEN ln % 2 = 0 THEN octet_length(line::BLOB) ELSE 0 END)::BIGINT AS bytes_after,
    sum(CASE WHEN ln % 2 = 0 THEN octet_length(line::BLOB) ELSE 0 END) < sum(octet_length(line::BLOB)) AS smaller FROM L JOIN documents USING (doc_id) GROUP BY source""".replace("octet_length(line::BLOB)", "strlen(line)"))
def _(t):
    lines = R.text_lines(t["documents"].select("doc_id", "text")).join(t["documents"].select("doc_id", F.col("source").alias("vdoc")), "doc_id")
    return W.size_report(lines, lines.where("ln % 2 = 0"))


# ---- ranges and predicates

SPECS = ["3-", "-2", "4-2", "99", "1,3-4", "", "abc", "1,x", "0", "1-0", " 2 , 5 - 7 ", "1,,3", "2,", "-", " , ", "1-2-3"]


@query("p1_parse_page_range", "M", """, x AS (SELECT vdoc, count(*) AS n FROM M GROUP BY vdoc), s AS (SELECT vdoc, n, unnest(['3-', '-2', '4-2', '99', '1,3-4', '', ' 2 , 5 - 7 ', '1,,3', '2,', '-']) AS spec FROM x),
    e AS (SELECT vdoc, spec, n, trim(unnest(string_split(CASE WHEN spec IN ('', '-') THEN '1-' ELSE spec END, ','))) AS term FROM s),
    r AS (SELECT vdoc, spec, n, CASE WHEN term LIKE '-%' THEN 1 ELSE trim(split_part(term, '-', 1))::BIGINT END AS a, CASE WHEN term LIKE '%-' THEN n WHEN term LIKE '%-%' THEN trim(split_part(term, '-', 2))::BIGINT ELSE term::BIGINT END AS b FROM e WHERE term <> '')
    SELECT DISTINCT vdoc || ':' || spec AS k, unnest(range(least(a, b, n), least(greatest(a, b), n) + 1)) - 1 AS page FROM r""")
def _(t):
    n = t.pages_of.groupBy("vdoc").agg(F.count("*").alias("n"))
    rows = n.select("vdoc", "n", F.explode(F.array(*[F.lit(s) for s in SPECS])).alias("spec")).withColumn("k", F.concat_ws(":", "vdoc", "spec"))
    return P.parse_page_range(rows, "k", "spec", "n")[0]


@query("p1_page_range_errors", "M", "SELECT DISTINCT vdoc || ':' || spec AS k, spec FROM (SELECT vdoc, unnest(['abc', '1,x', '0', '1-0', ' , ', '1-2-3']) AS spec FROM M)")
def _(t):
    n = t.pages_of.groupBy("vdoc").agg(F.count("*").alias("n"))
    rows = n.select("vdoc", "n", F.explode(F.array(*[F.lit(s) for s in SPECS])).alias("spec")).withColumn("k", F.concat_ws(":", "vdoc", "spec"))
    return P.parse_page_range(rows, "k", "spec", "n")[1]


@query("p2_format_page_range", "M", """SELECT vdoc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS spec FROM (
    SELECT vdoc, min(pos) + 1 AS a, max(pos) + 1 AS b FROM (SELECT vdoc, pos, pos - row_number() OVER (PARTITION BY vdoc ORDER BY pos) AS g FROM M WHERE pos % 5 <> 2) GROUP BY vdoc, g) GROUP BY vdoc""")
def _(t):
    return P.format_page_range(t.manifest.where("pos % 5 <> 2").select("vdoc", F.col("pos").alias("page")), "vdoc")


@query("p3_listed_marks", "B", "SELECT page, z, kind FROM B WHERE kind IN ('highlight', 'underline', 'strikeout')")
def _(t):
    return P.listed_marks(t.bars).select("page", "z", "kind")


@query("p4_free_placed", "B", "SELECT page, z, kind FROM B WHERE kind = 'ink'")
def _(t):
    return P.free_placed(t.bars).select("page", "z", "kind")


@query("p5_geometric", "B", "SELECT page, z FROM B WHERE z % 3 = 0")
def _(t):
    box = F.array(F.struct("x0", "x1"))
    return P.geometric(t.bars.withColumn("bars", F.when(F.col("z") % 3 == 0, box).when(F.col("z") % 3 == 1, F.slice(box, 1, 0)))).select("page", "z")


@query("p6_image_only_pages", "PG L", "SELECT source_id AS doc_id, page FROM PG WHERE source_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM L WHERE L.doc_id = PG.source_id AND L.page = PG.page AND length(line) > 60)")
def _(t):
    pages = t.pages_of.select(F.col("source_id").alias("doc_id"), "page")
    return P.image_only_pages(pages, t.lines.where(F.length("line") > 60), pages.where("doc_id % 2 = 0"))


@query("p7_has_redactions", "B", "SELECT page, bool_or(kind = 'ink') AS has FROM B GROUP BY page")
def _(t):
    return P.has_kind(t.bars, "page", ["ink"])


@query("p8_covers_page", "B", "SELECT page, z FROM B WHERE NOT (x1 - x0 >= 0.98 * 40 AND x0 + line >= 0.98 * 50)")
def _(t):
    return P.without_page_covers(t.bars.withColumns({"y0": F.lit(0), "y1": F.col("x0") + F.col("line")}), 40, 50).select("page", "z")


# ---- manifest edits

RENUM = "row_number() OVER (PARTITION BY vdoc ORDER BY {}) - 1 AS pos"


@query("m1_seed_manifest", "M", "SELECT vdoc, pos, source_id, page FROM M")
def _(t):
    return t.manifest.select(*MCOLS)


@query("m2_move_page", "M", f"SELECT vdoc, {RENUM.format('CASE WHEN pos = 3 THEN 10.5 ELSE pos END')}, source_id, page FROM M")
def _(t):
    m = t.manifest
    return M.move_page(m, m.select("vdoc").distinct().withColumns({"src": F.lit(3), "dst": F.lit(10)})).select(*MCOLS)


@query("m3_move_pages", "M", f"SELECT vdoc, {RENUM.format('CASE WHEN pos % 5 = 2 THEN 1 WHEN pos < 7 THEN 0 ELSE 2 END, pos')}, source_id, page FROM M")
def _(t):
    m = t.manifest
    return M.move_pages(m, picked(m), m.select("vdoc").distinct().withColumn("before", F.lit(7))).select(*MCOLS)


@query("m4_delete_pages", "M", f"SELECT vdoc, {RENUM.format('pos')}, source_id, page FROM M WHERE pos % 5 <> 2")
def _(t):
    m = t.manifest
    return M.delete_pages(m, picked(m)).select(*MCOLS)


@query("m5_insert_pages", "M", f"SELECT vdoc, {RENUM.format('k, t, n')}, source_id, page FROM (SELECT vdoc, source_id, page, pos AS k, 1 AS t, 0 AS n FROM M UNION ALL SELECT vdoc, source_id, page, 4, 0, pos FROM M WHERE pos % 5 = 2)")
def _(t):
    m = t.manifest
    refs = m.where("pos % 5 = 2").select("vdoc", F.lit(4).alias("at"), F.col("pos").alias("nth"), "source_id", "page")
    return M.insert_pages(m, refs, t["documents"].select(F.col("doc_id").alias("source_id"))).select(*MCOLS)


@query("m6_import_pages", "M", f"""SELECT vdoc, {RENUM.format('k, t, n')}, source_id, page FROM (SELECT vdoc, source_id, page, pos AS k, 1 AS t, 0 AS n FROM M
    UNION ALL SELECT 'src' || ((substr(vdoc, 4)::INT + 1) % 20)::VARCHAR, source_id, page, 2, 0, pos FROM M WHERE pos % 5 = 2)""")
def _(t):
    m = t.manifest
    return M.import_pages(m, m, picked(m), _next(m)).select(*MCOLS)


def _next(m: DataFrame) -> DataFrame:
    into = F.concat(F.lit("src"), ((F.substring("vdoc", 4, 9).cast("int") + 1) % 20).cast("string"))
    return m.select("vdoc").distinct().select("vdoc", into.alias("into"), F.lit(2).alias("at"))


@query("m7_cut_paste", "M", f"""SELECT 'from' AS side, vdoc, {RENUM.format('pos')}, source_id, page FROM M WHERE pos % 5 <> 2 UNION ALL
    SELECT 'to', vdoc, {RENUM.format('k, t, n')}, source_id, page FROM (SELECT vdoc, source_id, page, pos AS k, 1 AS t, 0 AS n FROM M
    UNION ALL SELECT 'src' || ((substr(vdoc, 4)::INT + 1) % 20)::VARCHAR, source_id, page, 2, 0, pos FROM M WHERE pos % 5 = 2)""")
def _(t):
    m = t.manifest
    a, b = M.cut_paste(m, picked(m), m, _next(m))
    return a.select(F.lit("from").alias("side"), *MCOLS).unionByName(b.select(F.lit("to").alias("side"), *MCOLS))


@query("m8_subset", "M", f"SELECT vdoc, {RENUM.format('pos')}, source_id, page, pos AS origin FROM M WHERE pos % 3 = 0")
def _(t):
    m = t.manifest
    return M.subset(m, picked(m, 3, 0)).select(*MCOLS, "origin")


@query("m9_duplicate_pages", "M", f"""SELECT vdoc, {RENUM.format('k, t, pos')}, source_id, page FROM (SELECT *, pos AS k, 0 AS t FROM M
    UNION ALL SELECT *, max(pos) OVER (PARTITION BY vdoc) AS k, 1 AS t FROM M WHERE pos % 5 = 2)""".replace(", pos - 1", ""))
def _(t):
    m = t.manifest
    return M.duplicate_pages(m, picked(m)).select(*MCOLS)


@query("m10_rotate", "M", "SELECT vdoc, pos, CASE WHEN pos % 5 = 2 THEN (native_rotation + 270) % 360 END AS rotation FROM M")
def _(t):
    m = t.manifest
    return M.rotate(m, picked(m), -90).select("vdoc", "pos", "rotation")


@query("m11_crop", "M", "SELECT vdoc, pos, CASE WHEN s THEN 540.0::DOUBLE END AS cx0, CASE WHEN s THEN 10.0::DOUBLE END AS cy0, CASE WHEN s THEN least(580.0::DOUBLE, fx1) END AS cx1, CASE WHEN s THEN 700.0::DOUBLE END AS cy1 FROM (SELECT *, pos % 5 = 2 AND fx1 > 540 AS s FROM M)")
def _(t):
    m = t.manifest
    return M.crop(m, picked(m), (540, 10, 580, 700), ["fx0", "fy0", "fx1", "fy1"]).select("vdoc", "pos", *M.CROP)


@query("m12_reset_crop", "M", "SELECT vdoc, pos, pos % 2 = 0 AND pos % 5 <> 2 AS cropped FROM M")
def _(t):
    frame = ["fx0", "fy0", "fx1", "fy1"]
    m = t.manifest
    m = M.crop(m, picked(m, 2, 0), (0, 5, 400, 700), frame)
    return M.reset_crop(m, picked(m), frame).select("vdoc", "pos", M.is_cropped(frame, frame).alias("cropped"))


@query("m13_visible_size", "M", """SELECT vdoc, pos, CASE WHEN native_rotation % 180 <> 0 THEN h ELSE w END AS width, CASE WHEN native_rotation % 180 <> 0 THEN w ELSE h END AS height
    FROM (SELECT *, CASE WHEN pos % 5 = 2 THEN 400.0::DOUBLE ELSE fx1 END AS w, CASE WHEN pos % 5 = 2 THEN 695.0::DOUBLE ELSE fy1 END AS h FROM M)""")
def _(t):
    frame = ["fx0", "fy0", "fx1", "fy1"]
    m = t.manifest
    return M.visible_size(M.crop(m, picked(m), (0, 5, 400, 700), frame), frame)


@query("m14_contiguous_runs", "M", """SELECT vdoc, min(pos) AS start, min(source_id) AS source_id, min(page) AS first_page, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY vdoc ORDER BY pos)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(source_id) OVER w = source_id AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END AS new
    FROM (SELECT vdoc, row_number() OVER (PARTITION BY vdoc ORDER BY pos) - 1 AS pos, source_id, page FROM M WHERE pos % 5 <> 2) WINDOW w AS (PARTITION BY vdoc ORDER BY pos))) GROUP BY vdoc, run""")
def _(t):
    m = t.manifest
    return M.contiguous_runs(M.delete_pages(m, picked(m)))


@query("m15_manifest_diff", "M", "SELECT vdoc, CASE WHEN max(pos) >= 100 THEN 'structural' WHEN substr(vdoc, 4)::INT % 2 = 0 THEN 'content' ELSE 'none' END AS change FROM M GROUP BY vdoc")
def _(t):
    m = t.manifest.withColumn("content", F.lit("a"))
    b = m.where("pos <> 100 OR false").withColumn("content", F.when(F.substring("vdoc", 4, 9).cast("int") % 2 == 0, "b").otherwise("a"))
    return M.manifest_diff(m, b)


@query("m16_apply_to_pages", "M", """SELECT vdoc, pos, 'stamp' AS kind FROM (SELECT vdoc, pos, count(*) OVER (PARTITION BY vdoc) AS n FROM M)
    WHERE pos BETWEEN least(2, n) - 1 AND least(4, n) - 1 OR pos >= least(10, n) - 1""")
def _(t):
    m = t.manifest
    given = m.groupBy("vdoc").agg(F.count("*").alias("n")).withColumn("spec", F.lit("2-4, 10-"))
    pages = P.parse_page_range(given, "vdoc", "spec", "n")[0].withColumnRenamed("page", "pos")
    return M.apply_to_pages(m, pages, {"kind": F.lit("stamp")})


# ---- links, outline, fields



#: A manifest with every fifth page once more behind the last of them: its first place counts.
DUP = f"(SELECT vdoc, source_id, page, {RENUM.format('k, t, pos')} FROM (SELECT *, pos AS k, 0 AS t FROM M UNION ALL SELECT *, max(pos) OVER (PARTITION BY vdoc) AS k, 1 AS t FROM M WHERE pos % 5 = 2))"
DTGT = f"(SELECT vdoc, source_id, page, min(pos) AS tp FROM {DUP} GROUP BY ALL)"


@query("j1_link_targets", "M", f"SELECT vdoc, source_id, page, tp AS pos FROM {DTGT}")
def _(t):
    m = t.manifest
    return K.link_targets(M.duplicate_pages(m, picked(m)))


@query("j2_remap_links", "M KR", f"SELECT m.vdoc, m.pos, k.link_no, t.tp AS target_pos FROM {DUP} m JOIN KR k USING (source_id, page) JOIN {DTGT} t ON t.vdoc = m.vdoc AND t.source_id = m.source_id AND t.page = k.target_page WHERE k.kind <> 'uri'")
def _(t):
    m = t.manifest
    return K.remap_links(M.duplicate_pages(m, picked(m)), K.resolve_named(t.links, t.dests))


CUT = "(SELECT * FROM M WHERE pos % 5 <> 2)"


@query("j3_dangling_links", "M K", f"SELECT m.vdoc, m.pos, k.link_no FROM (SELECT vdoc, row_number() OVER (PARTITION BY vdoc ORDER BY pos) - 1 AS pos, source_id, page FROM {CUT}) m JOIN K k USING (source_id, page) WHERE k.kind <> 'uri' AND NOT EXISTS (SELECT 1 FROM {CUT} t WHERE t.vdoc = m.vdoc AND t.source_id = m.source_id AND t.page = k.target_page)")
def _(t):
    m = t.manifest
    return K.dangling_links(M.delete_pages(m, picked(m)), t.links)


@query("j4_resolve_named", "KR", "SELECT source_id, page, link_no, kind, target_page FROM KR")
def _(t):
    return K.resolve_named(t.links, t.dests).select("source_id", "page", "link_no", "kind", "target_page")


@query("j5_lost_uris", "K", "SELECT source_id AS doc_id, page, uri FROM K WHERE uri IS NOT NULL AND NOT EXISTS (SELECT 1 FROM K o WHERE o.source_id = K.source_id AND o.page = K.page AND o.uri = K.uri AND o.link_no % 7 <> 0)")
def _(t):
    k = t.links.select(F.col("source_id").alias("doc_id"), "page", "uri", "link_no", F.lit(0.001).alias("x0"), F.lit(1.0).alias("y0"), F.col("w").cast("double").alias("x1"), F.lit(2.0).alias("y1"))
    return K.lost_uris(k, k.where("link_no % 7 <> 0").withColumn("x0", F.lit(0.002)))


@query("j6_remap_outline", "T M", "SELECT t.doc_id, t.seq, t.level, t.title, m.np + 1 AS page FROM T t JOIN (SELECT vdoc, source_id, page, row_number() OVER (PARTITION BY vdoc ORDER BY pos) - 1 AS np FROM M WHERE pos % 5 <> 2) m ON m.source_id = t.doc_id AND m.page = t.page")
def _(t):
    m = t.manifest
    index = M.delete_pages(m, picked(m)).select("source_id", F.col("page").alias("old"), F.col("pos").alias("new"))
    o = t.outline.withColumn("source_id", F.col("doc_id")).withColumn("page", F.col("page") + 1)
    return K.remap_outline(o, index).select("doc_id", "seq", "level", "title", "page")


@query("j7_section_of_page", "T PG", "SELECT p.source_id AS doc_id, p.page, (SELECT max(seq) FROM T WHERE T.doc_id = p.source_id AND T.page <= p.page) AS seq FROM PG p")
def _(t):
    return K.section_of_page(t.outline, t.pages_of.select(F.col("source_id").alias("doc_id"), F.col("page").cast("long").alias("page")))


@query("j8_apply_fills", "F", "SELECT doc_id, name, CASE WHEN doc_id % 3 = 0 AND name = 'status' THEN 'X' WHEN doc_id % 3 = 1 AND name = 'priority' THEN '' ELSE value END AS value FROM F")
def _(t):
    o = t["orders"]
    fills = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("status").alias("name"), F.lit("X").alias("value")).unionByName(o.where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("doc_id"), F.lit("priority").alias("name"), F.lit(None).cast("string").alias("value")))
    return K.apply_fills(t.fields, fills).select("doc_id", "name", "value")


@query("j9_merge_fields", "", "SELECT vdoc, source_id, CASE WHEN n = 1 THEN name ELSE name || '_' || n::VARCHAR END AS name FROM (SELECT vdoc, source_id, name, dense_rank() OVER (PARTITION BY vdoc, name ORDER BY source_id) AS n FROM (SELECT o_custkey AS vdoc, o_orderkey AS source_id, o_orderpriority AS name FROM orders))")
def _(t):
    return K.merge_fields(t["orders"].select(F.col("o_custkey").alias("vdoc"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("name")))


@query("j10_create_fields", "", """SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderstatus = 'O' THEN 'Field' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR ELSE o_orderstatus END AS name,
    CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'combobox' ELSE 'checkbox' END AS type, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'false' END AS value FROM orders""")
def _(t):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "text").when(F.col("o_orderkey") % 3 == 1, "combobox").otherwise("checkbox")
    new = t["orders"].select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus")).alias("name"), kind.alias("type"), F.lit(None).cast("string").alias("value"), F.array(F.lit("a"), F.lit("b")).alias("choices"))
    return K.create_fields(new)


@query("j24_link_graph", "", f"""SELECT h.page_id AS from_page, p.page_id AS to_page, count(*) AS links FROM ({HREFS}) h JOIN (SELECT page_id, '/' || regexp_extract(html, '<title>([^ <]*)', 1) AS key FROM pages) p ON p.key = h.href GROUP BY ALL""")
def _(t):
    held = t["pages"].select(F.col("page_id").alias("to_page"), F.concat(F.lit("/"), F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("key"))
    return K.link_graph(held, R.read_links(t["pages"]).select(F.col("page_id").alias("from_page"), F.col("href").alias("key")))


REP = """WITH RECURSIVE r AS (SELECT doc_id, seq, level, title, page, 1::BIGINT AS fixed, [level] AS open FROM T WHERE seq = 0
    UNION ALL SELECT t.doc_id, t.seq, t.level, t.title, t.page, len(list_filter(r.open, lambda o: o < t.level)) + 1, list_append(list_filter(r.open, lambda o: o < t.level), t.level) FROM r JOIN T t ON t.doc_id = r.doc_id AND t.seq = r.seq + 1) """


@query("o1_repair_levels", "T", REP + "SELECT doc_id, seq, fixed AS level, title, page FROM r")
def _(t):
    return K.repair_levels(t.outline)


@query("o2_outline_tree", "T", REP + "SELECT doc_id, seq, (SELECT max(seq) FROM r p WHERE p.doc_id = r.doc_id AND p.seq < r.seq AND p.fixed = r.fixed - 1) AS parent FROM r")
def _(t):
    return K.outline_tree(t.outline)


@query("o3_outline_path", "T", """WITH RECURSIVE r AS (SELECT doc_id, seq, [level] AS open, [title] AS names FROM T WHERE seq = 0
    UNION ALL SELECT t.doc_id, t.seq, list_append(list_filter(r.open, lambda o: o < t.level), t.level), list_append(r.names[1:len(list_filter(r.open, lambda o: o < t.level))], t.title) FROM r JOIN T t ON t.doc_id = r.doc_id AND t.seq = r.seq + 1)
    SELECT doc_id, seq, array_to_string(names, ' > ') AS path FROM r""")
def _(t):
    return K.outline_path(t.outline)


@query("o4_extract_outline", "T M", """WITH RECURSIVE c AS (SELECT source_id, page, row_number() OVER (PARTITION BY vdoc ORDER BY pos) AS np FROM M WHERE pos % 3 = 0),
    u AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.seq) - 1 AS n, t.seq, t.level, t.title, c.np AS page FROM T t JOIN c ON c.source_id = t.doc_id AND c.page = t.page),
    r AS (SELECT doc_id, n, seq, title, page, level, 1::BIGINT AS fixed, [level] AS open FROM u WHERE n = 0
    UNION ALL SELECT u.doc_id, u.n, u.seq, u.title, u.page, u.level, len(list_filter(r.open, lambda o: o < u.level)) + 1, list_append(list_filter(r.open, lambda o: o < u.level), u.level) FROM r JOIN u ON u.doc_id = r.doc_id AND u.n = r.n + 1)
    SELECT doc_id, seq, fixed AS level, title, page FROM r""")
def _(t):
    m = t.manifest
    index = M.subset(m, picked(m, 3, 0)).select("source_id", F.col("page").alias("old"), F.col("pos").alias("new"))
    o = t.outline.withColumn("source_id", F.col("doc_id")).withColumn("page", F.col("page") + 1)
    return K.repair_levels(K.remap_outline(o, index)).select("doc_id", "seq", "level", "title", "page")
