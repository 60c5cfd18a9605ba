"""Search over lines and words, selections and redaction. Offsets are columns from 0; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.readers import line_texts, line_words, piece_starts, running

ELLIPSIS = "…"


def query_terms(query: str, whole: bool) -> list[str]:
    """One phrase as it stands, or the words split by white space; an empty query has no terms."""
    return ([query] if query else []) if whole else query.split()


def _occurrences(line: str, term: str) -> str:
    """SQL for the places (c0, c1), in columns of the line, at which the lower-cased term stands in the lower-cased line, not overlapping.

    Lower-casing can make a line longer (İ becomes two characters): then an array, built once a line, leads from columns of the lower-cased line back to those
    of the line, and a place covers every character that it has a part of.
    """
    pieces = f"split(lower({line}), concat('\\\\Q', lower({term}), '\\\\E'), -1)"
    starts = f"transform(array({pieces}), ps -> transform(slice({piece_starts('ps', f'length(lower({term}))')}, 2, size(ps)), x -> x - length(lower({term}))))[0]"
    back = f"flatten(transform(regexp_extract_all({line}, '(?s)(.)', 1), (c, i) -> array_repeat(i, length(lower(c)))))"
    moved = f"transform(array({back}), m -> transform({starts}, f -> named_struct('c0', m[f], 'c1', m[f + length(lower({term})) - 1] + 1)))[0]"
    return f"if(length(lower({line})) = length({line}), transform({starts}, f -> named_struct('c0', f, 'c1', f + length(lower({term})))), {moved})"


def search_terms(lines: DataFrame, term: Column) -> DataFrame:
    """doc_id, ln, page, line_no, line, term, c0, c1 for each place of lines(term): one pass over the line, no shuffle."""
    rows = lines.withColumn("term", term).where((F.col("term") != "") & F.contains(F.lower("line"), F.lower("term")))
    rows = rows.select("doc_id", "ln", "page", "line_no", "line", "term", F.explode(F.expr(_occurrences("line", "term"))).alias("at"))
    return rows.select("doc_id", "ln", "page", "line_no", "line", "term", "at.c0", "at.c1")


def search(lines: DataFrame, query: str, whole: bool = False, case: bool = False) -> DataFrame:
    """Hits of a query: any of its words, inside longer words too, or (whole) the phrase with no word sticking out of it."""
    terms = query_terms(query, whole)
    if not terms:
        return search_terms(lines, F.lit("")).limit(0)
    hits = dedupe_hits(search_terms(lines, F.explode(F.array(*[F.lit(t) for t in terms])) if len(terms) > 1 else F.lit(terms[0])), terms) if len(terms) > 1 else search_terms(lines, F.lit(terms[0]))
    if case:
        hits = match_case(hits)
    return whole_words(hits) if whole else hits


def match_case(hits: DataFrame) -> DataFrame:
    """Hits whose text is the term, letter case and all; outer blanks of the text don't count."""
    return hits.where(F.trim(F.expr("substring(line, c0 + 1, c1 - c0)")) == F.col("term"))


def whole_words(hits: DataFrame) -> DataFrame:
    """Hits at whose ends no word goes on: a blank, or the line's end, is on both sides."""
    before, after = F.expr("substring(line, c0, 1)"), F.expr("substring(line, c1 + 1, 1)")
    return hits.where(((F.col("c0") == 0) | (before == " ")) & ((F.col("c1") >= F.length("line")) | (after == " ")))


def dedupe_hits(hits: DataFrame, terms: list[str]) -> DataFrame:
    """One hit where several terms have the same box: the first term's."""
    rank = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term"))
    w = Window.partitionBy("doc_id", "ln", "c0", "c1").orderBy(rank)
    return hits.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def exclude_overlays(hits: DataFrame, overlays: DataFrame) -> DataFrame:
    """Hits less those whose centre lies in an overlay(doc_id, page, line_no, o0, o1)."""
    o = overlays.select(F.col("doc_id").alias("od"), F.col("page").alias("op"), F.col("line_no").alias("ol"), "o0", "o1")
    middle = (F.col("c0") + F.col("c1")) / 2
    return hits.join(o, (F.col("doc_id") == F.col("od")) & (F.col("page") == F.col("op")) & (F.col("line_no") == F.col("ol")) & middle.between(F.col("o0"), F.col("o1")), "left_anti")


def order_hits(hits: DataFrame) -> DataFrame:
    """nth: a hit's place in its page's reading order."""
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no", "c0", "c1")))


def snippets(hits: DataFrame, k: int = 4) -> DataFrame:
    """snippet: the words around a hit on its line, k on each side, with an ellipsis where some are left out. In the row, without a join.

    A hit looks at the characters near it alone, so a long line with many hits isn't split again for each of them.
    """
    near = 40 * (k + 2)  # characters that mostly hold k words and one more on a side; where they don't, the whole side is split

    def side(whole: str, part: str, cut: str) -> Column:
        words = lambda of: f"filter(split({of}, ' '), x -> x <> '')"
        return F.expr(f"transform(array({words(part)}), w -> if(NOT ({cut}) OR size(w) >= {k + 3}, w, {words(whole)}))[0]")

    before = side("substring(line, 1, c0)", f"substring(line, greatest(c0 - {near}, 0) + 1, least(c0, {near}))", f"c0 > {near}")
    glued_left = (F.col("c0") > 0) & (F.expr("substring(line, c0, 1)") != " ")
    after = side("substring(line, c1 + 1)", f"substring(line, c1 + 1, {near})", f"length(line) - c1 > {near}")
    glued_right = F.expr("substring(line, c1 + 1, 1)").isin("", " ") == F.lit(False)
    rows = hits.withColumns({"_b": before, "_a": after, "_gl": glued_left, "_gr": glued_right})
    left, right = k + F.col("_gl").cast("int"), k + F.col("_gr").cast("int")
    head = F.expr("slice(_b, greatest(size(_b) - _l, 0) + 1, _l)")
    tail = F.expr("slice(_a, 1, _r)")
    rows = rows.withColumns({"_l": left, "_r": right}).withColumns({"_h": head, "_t": tail})
    text = F.concat(
        F.when(F.size("_b") > F.col("_l"), ELLIPSIS + " ").otherwise(""), F.array_join("_h", " "), F.when((F.size("_h") > 0) & ~F.col("_gl"), " ").otherwise(""),
        F.expr("substring(line, c0 + 1, c1 - c0)"), F.when((F.size("_t") > 0) & ~F.col("_gr"), " ").otherwise(""), F.array_join("_t", " "), F.when(F.size("_a") > F.col("_r"), " " + ELLIPSIS).otherwise(""),
    )
    return rows.withColumn("snippet", text).drop("_b", "_a", "_gl", "_gr", "_l", "_r", "_h", "_t")


def hit_position(hits: DataFrame) -> DataFrame:
    """label: n of total in the document."""
    w = Window.partitionBy("doc_id")
    n, total = F.row_number().over(w.orderBy("page", "line_no", "c0", "c1")), F.count("*").over(w)
    return hits.withColumn("label", F.concat(n.cast("string"), F.lit(" of "), total.cast("string")))


def hit_listing(hits: DataFrame) -> DataFrame:
    """doc_id, ln, c0, row: the page from 1 and the snippet."""
    return snippets(hits).select("doc_id", "ln", "c0", F.concat(F.lit("p. "), (F.col("page") + 1).cast("string"), F.lit("   "), F.col("snippet")).alias("row"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Hits by document and page, by document, and in all (rollup: null stands for all)."""
    return hits.rollup("doc_id", "page").agg(F.count("*").alias("hits"))


def _bounded(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df with a hint to broadcast it where a count shows that it has `most` rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_STRETCH = 64


def token_key(token: Column) -> Column:
    """A token of up to 64 characters itself, a longer one's digest behind a #: what tells tokens apart in joins, without their text."""
    return F.when(F.length(token) <= _STRETCH, token).otherwise(F.concat(F.lit("#"), F.sha2(token, 256)))


def _term_tokens(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term, at, whole for each place (from 0) at which a term's head, that is the term up to its first blank, stands in one of tokens(token).

    An index of grams: the first three characters of a head (fewer of a shorter one) meet equal ones of the tokens, and the rest is looked at for those alone. Tokens
    are cut into stretches that overlap by the longest head, so a place costs a stretch, however long its token is, and rows carry a key for
    the token. Of a term with a blank (whole is false then) the head must end the token; a head that is empty stands at the end alone.
    """
    heads = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().withColumn("head", F.split("term", " ")[0])
    heads = heads.withColumns({"whole": F.col("head") == F.col("term"), "gram": F.substring("head", 1, 3)})
    sizes = [r.n for r in heads.groupBy(F.length("gram").alias("n")).agg(F.max(F.length("head")).alias("m")).collect()]  # four rows at most
    longest = heads.agg(F.max(F.length("head"))).first()[0] or 0
    stretch = max(_STRETCH, longest)
    salts = 64
    cut = tokens.distinct().select(token_key(F.col("token")).alias("key"), F.length("token").alias("n"), F.xxhash64("token").alias("h"), F.expr(f"regexp_extract_all(token, '(?s).{{1,{stretch}}}', 0)").alias("parts"))
    pieces = F.expr(f"transform(parts, (p, i) -> named_struct('base', i * {stretch}, 'own', length(p), 'piece', concat(p, substring(coalesce(get(parts, i + 1), ''), 1, {max(longest - 1, 0)}))))")
    rows = cut.select("key", "n", F.explode(pieces).alias("p")).select("key", "n", "p.*")
    lengths = [k for k in sizes if k]
    grams = F.array(*[F.expr(f"substring(piece, off + 1, {k})") for k in lengths]) if lengths else F.array().cast("array<string>")
    at = rows.withColumn("off", F.explode(F.expr("sequence(0, own - 1)"))).select("key", "n", "base", "piece", "off", F.explode(F.array_distinct(grams)).alias("gram"))
    met = at.join(_bounded(heads.where("gram <> ''")), "gram").where("substring(piece, off + 1, length(head)) = head AND (whole OR base + off + length(head) = n)")
    out = met.select("key", "term", (F.col("base") + F.col("off")).alias("at"), "whole")
    if 0 in sizes:
        spread = heads.where("gram = ''").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        ends = cut.select("key", F.col("n").alias("at"), F.pmod("h", F.lit(salts)).cast("int").alias("salt")).join(_bounded(spread), "salt")
        out = out.unionByName(ends.select("key", "term", "at", "whole"))
    return out


#: So many terms are looked for in each line as it is; more go by an index of the distinct words.
FEW_TERMS = 32


def _places_in_lines(lines: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, page, ln, word_no, term for each place, overlapping ones too, of the lower-cased terms in the lower-cased words of a line, one blank apart.

    In the row, without a join or shuffle: a line is cut before each place, and the blanks in the pieces before a place tell its word.
    """
    cuts = [F.struct(F.lit(t).alias("term"), F.lit("(?=\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E)").alias("cut")) for t in terms]
    rows = line_texts(lines).select("doc_id", "page", "ln", F.lower("words").alias("low"))
    rows = rows.withColumn("t", F.explode(F.array(*cuts))).where("contains(low, t.term)")
    before = running("transform(split(low, t.cut, -1), x -> length(x) - length(replace(x, ' ', '')))")
    at = F.expr(f"transform(array({before}), b -> if(startswith(low, t.term), b, slice(b, 2, size(b))))[0]")
    return rows.select("doc_id", "page", "ln", F.explode_outer(at).alias("word_no"), "t.term")  # no array is empty; Spark would work out that of a plain explode twice, to test it


def search_dictionary(lines: DataFrame, terms: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, page, ln, word_no, term: every one of terms(term) searched over every line, letter case aside, in one pass for all terms.

    whole: terms that are words, outer marks stripped. Else terms stand inside longer words too, and may be phrases; a place is the word it begins in,
    once for each time it stands there.
    """
    words = line_words(lines)
    if whole:
        small = _bounded(terms.select(F.lower("term").alias("term")).distinct())
        token = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return words.withColumn("term", token).join(small, "term").select("doc_id", "page", "ln", "word_no", "term")
    few = [r.term for r in terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().limit(FEW_TERMS + 1).collect()]
    if 0 < len(few) <= FEW_TERMS:
        return _places_in_lines(lines, few)
    words = words.withColumn("token", F.lower("word"))
    keyed = words.select("doc_id", "page", "ln", "word_no", token_key(F.col("token")).alias("key"))
    from quire.sources.sinks import shared_path

    # What terms stand in is known before words are joined: where it is small, words meet it where they are.
    path = shared_path(lines.sparkSession, "term-tokens")
    held = _term_tokens(words.select("token"), terms)
    held.write.parquet(path)
    met = keyed.join(_bounded(lines.sparkSession.read.schema(held.schema).parquet(path), 1 << 18), "key")
    # A phrase goes on in the words behind it: its line is looked at again, once for all places in it that a head is at.
    heads = met.where("NOT whole").groupBy("doc_id", "ln").agg(F.collect_list(F.struct("page", "word_no", "term", "at")).alias("hits"))
    tail = lines.select("doc_id", "ln", F.expr("filter(split(lower(line), ' ', -1), x -> x <> '')").alias("ws"))
    goes_on = "filter(hits, h -> substring(array_join(slice(ws, h.word_no + 1, 1 + length(h.term)), ' '), h.at + 1, length(h.term)) = h.term)"
    rest = heads.join(tail, ["doc_id", "ln"]).select("doc_id", "ln", F.explode(F.expr(goes_on)).alias("h")).select("doc_id", "h.page", "ln", "h.word_no", "h.term")
    return met.where("whole").select("doc_id", "page", "ln", "word_no", "term").unionByName(rest)


def select_range(words: DataFrame, a: tuple[int, int, int], b: tuple[int, int, int]) -> DataFrame:
    """Words from one (page, line_no, word_no) to another, both in, in either order; pages limit the scan."""
    low, high = min(a, b), max(a, b)
    at = F.struct("page", "line_no", "word_no")
    ends = [F.struct(*[F.lit(x) for x in e]) for e in (low, high)]
    return words.where(F.col("page").between(low[0], high[0]) & (at >= ends[0]) & (at <= ends[1]))


def select_all(words: DataFrame) -> DataFrame:
    """doc_id, first_page, last_page, words: a document's ends are its first and last page with words."""
    return words.groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("words"))


def line_bars(words: DataFrame) -> DataFrame:
    """One bar a line over the selected words, from the first to the last: gaps and word lengths don't show."""
    return words.groupBy("doc_id", "page", "line_no").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))


def selected_text(words: DataFrame) -> DataFrame:
    """doc_id, page, content: blanks between words, line feeds between lines."""
    one = words.groupBy("doc_id", "page", "line_no").agg(F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("w"))
    text = F.array_join(F.col("w.word"), " ")
    rows = one.select("doc_id", "page", F.struct("line_no", text.alias("t")).alias("l")).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return rows.select("doc_id", "page", F.array_join(F.col("l.t"), "\n").alias("content"))


def lines_text(lines: DataFrame) -> DataFrame:
    """doc_id, page, content: `selected_text` of all words of lines (see `line_texts`). Lines of one number on a page, as of repeated documents, are put together by word."""
    rows = lines.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("line_no").alias("n"), F.col("words").alias("t"))).alias("ls"))
    several = "transform(array_sort(flatten(transform(filter(ls, x -> x.n = n), x -> transform(split(x.t, ' ', -1), (w, i) -> named_struct('i', i, 'w', w))))), y -> y.w)"
    merged = f"transform(array_sort(array_distinct(ls.n)), n -> array_join({several}, ' '))"
    return rows.select("doc_id", "page", F.expr(f"array_join(if(size(ls) = size(array_distinct(ls.n)), transform(array_sort(ls), x -> x.t), {merged}), '\n')").alias("content"))


def words_under(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Words that strictly overlap a box(doc_id, page, line_no, b0, b1) of their line."""
    return words.join(boxes.select("doc_id", "page", "line_no", "b0", "b1"), ["doc_id", "page", "line_no"]).where("c0 < b1 AND b0 < c1")


def text_under(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, b0, b1, content: the characters whose centre lies in the box."""
    rows = lines.join(boxes.select("doc_id", "page", "line_no", "b0", "b1"), ["doc_id", "page", "line_no"])
    first, last = F.greatest(F.ceil(F.col("b0") - 0.5), F.lit(0)), F.floor(F.col("b1") - 0.5)
    rows = rows.withColumns({"_a": first.cast("int"), "_n": F.greatest(last - first + 1, F.lit(0)).cast("int")})
    return rows.select("doc_id", "page", "line_no", "b0", "b1", F.expr("substring(line, _a + 1, _n)").alias("content"))


def mark_matches(hits: DataFrame) -> DataFrame:
    """One redaction a page that holds the page's boxes, in order."""
    boxes = F.array_sort(F.collect_set(F.struct("line_no", "c0", "c1")))
    return hits.groupBy("doc_id", "page").agg(boxes.alias("boxes"))


def review(hits: DataFrame, unticked: DataFrame) -> DataFrame:
    """Everything but what was unticked."""
    return hits.join(unticked.select("doc_id", "ln", "c0").distinct(), ["doc_id", "ln", "c0"], "left_anti")


def apply_redactions(lines: DataFrame, boxes: DataFrame, fill: str | None = None) -> DataFrame:
    """Lines with the text under boxes(doc_id, page, line_no, c0, c1) taken out; with fill, each cut leaves that text alone, whatever its length.

    A line's boxes that overlap are merged, those that only touch are cuts of their own; all are cut from the line's end, in one fold. Lines without boxes aren't touched.
    """
    spans = boxes.groupBy("doc_id", "page", "line_no").agg(F.array_sort(F.collect_set(F.struct("c0", "c1"))).alias("spans"))
    rows = lines.join(spans, ["doc_id", "page", "line_no"], "left")
    merge = "aggregate(spans, cast(array() AS array<struct<c0:int,c1:int>>), (a, x) -> if(size(a) > 0 AND x.c0 < a[size(a) - 1].c1, concat(slice(a, 1, size(a) - 1), array(named_struct('c0', a[size(a) - 1].c0, 'c1', greatest(a[size(a) - 1].c1, x.c1)))), concat(a, array(named_struct('c0', x.c0, 'c1', x.c1)))))"
    mark = (fill or "").replace("'", "''")
    cut = f"aggregate(reverse(merged), line, (s, x) -> concat(substring(s, 1, x.c0), '{mark}', substring(s, x.c1 + 1)))"
    typed = rows.withColumn("spans", F.col("spans").cast("array<struct<c0:int,c1:int>>")).withColumn("merged", F.expr(merge))
    return typed.withColumn("line", F.when(F.col("merged").isNotNull(), F.expr(cut)).otherwise(F.col("line"))).select(*lines.columns)


def leak_check(redacted: DataFrame, terms: DataFrame) -> DataFrame:
    """term, leaks: how often each term still stands in the redacted lines, not overlapping; all 0 when the redaction is sound.

    Words are counted first, then each distinct word is checked for the terms once: neither lines times terms nor a limit on the terms.
    """
    from quire.sources.sinks import shared_path

    # Redacting is most of the work and the lines are looked at three times: they are written once.
    path = shared_path(redacted.sparkSession, "redacted-lines")
    redacted = redacted.select("doc_id", "ln", "page", "line_no", "line")
    redacted.write.parquet(path)
    redacted = redacted.sparkSession.read.schema(redacted.schema).parquet(path)
    out = terms.select("term").distinct()
    tokens = line_words(redacted).groupBy(F.lower("word").alias("token")).agg(F.count("*").alias("n"))
    met = _term_tokens(tokens.select("token"), out)
    inside = met.where("whole").select("key", "term").distinct().join(tokens.withColumn("key", token_key(F.col("token"))), "key")
    times = F.floor((F.length("token") - F.length(F.replace("token", "term", F.lit("")))) / F.length("term"))
    found = inside.groupBy("term").agg(F.sum(F.col("n") * times).alias("n"))
    # Phrases: a line is split by a phrase where one of its words ends in the phrase's head; heads and words join on their last three characters.
    heads = out.select(F.lower("term").alias("term"), F.split(F.lower("term"), " ")[0].alias("head")).where("contains(term, ' ')").distinct()
    heads = heads.withColumn("key", F.expr("right(head, 3)"))
    lengths = [r.n for r in heads.select(F.length("key").alias("n")).distinct().collect()]  # four at most
    low = redacted.select("doc_id", "ln", F.lower("line").alias("low"))
    ends = low.select("doc_id", "ln", F.explode(F.array_distinct(F.split("low", " ", -1))).alias("token"))
    keys = F.array(*[F.expr(f"right(token, {k})") for k in lengths]) if lengths else F.array().cast("array<string>")
    ends = ends.withColumn("key", F.explode(F.array_distinct(keys)))
    near = ends.join(_bounded(heads), "key").where("endswith(token, head)").select("doc_id", "ln", "term").distinct()
    pieces = F.size(F.expr("split(low, concat('\\\\Q', term, '\\\\E'), -1)")) - 1
    phrases = near.join(low, ["doc_id", "ln"]).groupBy("term").agg(F.sum(pieces).alias("n"))
    every = found.unionByName(phrases).withColumnRenamed("term", "low")
    return out.join(every, F.lower("term") == F.col("low"), "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("leaks"))


def commit_redactions(lines: DataFrame, boxes: DataFrame, log: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(the redacted lines, read back from what was published; the log without the edits up to this commit).

    There is no way back: the published version holds no text that was under a box, all versions that were at the path before it are removed from disk, and earlier
    edits can't be undone into it. lines may be read from the version that is removed: the new one is complete by then.
    """
    from quire.sources.sinks import commit, read_committed

    commit(apply_redactions(lines, boxes), path, purge=True)
    published = read_committed(lines.sparkSession, path)
    last = log.groupBy("doc").agg(F.max(F.when(F.col("op") == "commit", F.struct("ts", "event_id"))).alias("done"))
    kept = log.join(last, "doc").where(F.col("done").isNull() | (F.struct("ts", "event_id") > F.col("done"))).drop("done")
    return published, kept
