"""SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from .common import LOWER, UPPER
from . import url_filters as U
from .licenses import PHRASES, SPREAD, TEMPLATES, WORD, template_tokens

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _places(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"list_filter(range(1, greatest(len(w) - {len(parts) - 2}, 1)), lambda i: {same})"


def licenses() -> str:
    phrases = ", ".join(f"{_places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    every = "list_concat(" * (len(PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(PHRASES)))
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)"
    rows = []
    for k, (text, label, needed) in enumerate(TEMPLATES):
        t = template_tokens(text)
        rows += [f"({k}, '{label}', '{x}', {x in template_tokens(needed)}, {len(t)}, {math.ceil(0.8 * len(t))}, {len(template_tokens(needed))})" for x in t]
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT doc_id, len(w) AS n_words, {phrases} FROM d),
f AS (SELECT doc_id, n_words, {every} AS a, {base} AS base FROM b),
t(k, label, token, own, n, need, owns) AS (VALUES {", ".join(rows)}),
p AS (SELECT doc_id, token, i, k, label, own, n, need, owns FROM (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM d) JOIN t USING (token)),
m AS (SELECT a.doc_id, a.label, count(DISTINCT b.token) / a.n AS share FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i BETWEEN a.i AND a.i + {SPREAD} * a.n - 1
    GROUP BY a.doc_id, a.k, a.label, a.i, a.n, a.need, a.owns HAVING count(DISTINCT b.token) >= a.need AND count(DISTINCT CASE WHEN b.own THEN b.token END) = a.owns),
g AS (SELECT doc_id, list(DISTINCT label) AS extra, max(share) AS best FROM m GROUP BY doc_id)
SELECT f.doc_id, n_words, len(a) AS n_base, list_min(a) - 1 AS first_word, list_max(a) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(extra, [])))), ',') AS labels, CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM f LEFT JOIN g ON g.doc_id = f.doc_id
"""


def _crc32(value: str) -> str:
    """SQL for the unsigned crc32 (polynomial 0xEDB88320) of a value's ASCII text; null for null."""
    step = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({value}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: {step}, 4294967295), 4294967295)"


def _levels(name: str, depth: int) -> str:
    """SQL for the levels above {name}0(k, p, h, n) and for each node's siblings, {name}s0 and so on, in runs of 16; a k with one node stays as it is."""
    out = []
    for j in range(depth):
        out.append(f"""{name}{j + 1} AS (SELECT k, p // 16 AS p, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, (n + 15) // 16 AS n FROM {name}{j} GROUP BY k, p // 16, n)""")
        frame = "string_agg(h, '') OVER (PARTITION BY k, p // 16 ORDER BY p ROWS BETWEEN {})"
        out.append(f"""{name}s{j} AS (SELECT k, p, coalesce({frame.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS l, coalesce({frame.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS r FROM {name}{j} WHERE n > 1)""")
    return ", ".join(out)


def merkle(depth: int = 6) -> str:
    """Trees of up to 16^depth leaves a source and as many sources."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), text]) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    steps = [("a", "f0", j) for j in range(depth)] + [("b", "q0", j) for j in range(depth)]
    joins = " ".join(f"LEFT JOIN {t}s{j} AS {t}{j} ON {t}{j}.k = {'o.k' if t == 'a' else '0'} AND {t}{j}.p = o.{'p' if t == 'a' else 'q'} // {16**j}" for t, _, j in steps)
    proof = " || ".join(f"coalesce({t}{j}.l || {t}{j}.r, '')" for t, _, j in steps)
    folds, last = [], "o.start"
    for i, (t, _, j) in enumerate(steps):
        folds.append(f"CASE WHEN {t}{j}.l IS NULL THEN {last} ELSE sha256({t}{j}.l || {last} || {t}{j}.r) END AS f{i}")
        last = f"f{i}"
    return f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS k, {leaf(part("text"))} AS leaf, CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN {leaf(part(low))} END AS changed FROM documents),
o0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM d),
a0 AS (SELECT k, p, leaf AS h, n FROM o0), {_levels("a", depth)},
u AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS q FROM a{depth}),
b0 AS (SELECT 0 AS k, q AS p, subroot AS h, count(*) OVER () AS n FROM u), {_levels("b", depth)},
o AS (SELECT o0.*, u.q, u.subroot, coalesce(changed, leaf) AS start FROM o0 JOIN u ON u.k = o0.k)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM (
    SELECT o.doc_id, o.leaf, o.subroot, (SELECT h FROM b{depth}) AS root, sha256({proof}) AS proof_sha256, {", ".join(folds)}, {last} AS folded FROM o {joins})
"""


def url_filters() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in U.RULES)
    depths = f"range({U.DEPTH + 1})"
    return rf"""
WITH r(h, p, v) AS (VALUES {rules}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
u0 AS (SELECT *, row_number() OVER () AS id, CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS parts FROM c),
u AS (SELECT *, list_concat(list_transform(parts[1:{U.DEPTH}], lambda s: regexp_replace(s, '[0-9]+', '#', 'g')), CASE WHEN len(parts) > {U.DEPTH} THEN ['**'] ELSE [] END) AS segs FROM u0),
f AS (SELECT id, max((length(h || p), h || p, v)) AS best FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id),
seen AS (SELECT host, i, segs[i + 1] AS s, count(*) AS n FROM u, (SELECT unnest({depths}) AS i) WHERE i < len(segs) GROUP BY ALL),
tot AS (SELECT host, i, count(*) AS t FROM u, (SELECT unnest({depths}) AS i) WHERE i < len(segs) GROUP BY ALL),
lits AS (SELECT host, list((i, s)) AS lits FROM seen JOIN tot USING (host, i) WHERE n >= {U.LEAST} AND n >= {U.SHARE}::DOUBLE * t GROUP BY host),
pl AS (SELECT page_id, u.host, path, best[2] AS rule, best[3] AS label, list_transform(segs, lambda s, i: CASE WHEN s = '**' OR list_contains(coalesce(lits, []), (i - 1, s)) THEN s ELSE '*' END) AS tpl FROM u LEFT JOIN f USING (id) LEFT JOIN lits USING (host)),
lv AS (SELECT host, tpl, count(*) AS n, count(*) FILTER (label = 'block') AS bl, count(label) AS lb FROM pl GROUP BY host, tpl),
rw AS (SELECT host, tpl, n, bl, lb, i, tpl[1:i] AS parent, tpl[i + 1] AS child, tpl[i + 2:] AS below FROM lv, (SELECT unnest({depths}) AS i) WHERE i < len(tpl) AND tpl[i + 1] NOT IN ('*', '**')),
c0 AS (SELECT host, parent, child, below, sum(n)::DOUBLE AS o, sum(bl)::DOUBLE AS bl, sum(lb)::DOUBLE AS lb FROM rw GROUP BY ALL),
cl AS (SELECT * FROM c0 JOIN (SELECT host, parent, child, max((o, below))[2] AS lead_to FROM c0 GROUP BY ALL) USING (host, parent, child)),
po AS (SELECT host, parent, lead_to, below, sum(o) AS pool FROM cl GROUP BY ALL),
ft AS (SELECT host, parent, lead_to, child, sum(o) AS n, sum(bl) AS bl, sum(lb) AS lb, sum(o * o / pool) AS sq FROM cl JOIN po USING (host, parent, lead_to, below) GROUP BY ALL),
pa AS (SELECT host, parent, lead_to, count(*) - 1 AS free, sum(pool) AS all_n FROM po GROUP BY ALL),
la AS (SELECT host, parent, lead_to, sum(bl) AS ab, sum(lb) AS al FROM ft GROUP BY ALL),
si AS (SELECT host, parent, lead_to, child FROM ft JOIN pa USING (host, parent, lead_to) JOIN la USING (host, parent, lead_to) WHERE round(all_n / n * sq - n, 6) <= round(free + {U.SPREAD}::DOUBLE * sqrt(2 * free) + {U.EFFECT}::DOUBLE * n, 6)
    AND (bl * al - ab * lb) * (bl * al - ab * lb) <= {U.SPREAD * U.SPREAD}::DOUBLE * ab * (al - ab) * lb),
me AS (SELECT host, tpl, list(i) AS spots FROM rw JOIN si USING (host, parent, child) WHERE (host, parent, lead_to) IN (SELECT (host, parent, lead_to) FROM si GROUP BY host, parent, lead_to HAVING count(*) > 1) GROUP BY host, tpl),
nm AS (SELECT lv.*, list_transform(tpl, lambda s, i: CASE WHEN list_contains(coalesce(spots, []), i - 1) THEN '*' ELSE s END) AS node FROM lv LEFT JOIN me USING (host, tpl)),
no AS (SELECT host, node, regexp_extract(host, '([^.]*[.])?[^.]*$') AS site, sum(bl)::DOUBLE AS bl, sum(lb)::DOUBLE AS lb FROM nm GROUP BY ALL),
ev AS (SELECT (sum(bl) + 1) / (sum(lb) + 2) AS p FROM no),
st AS (SELECT site, (sum(bl) + {U.WEIGHT}::DOUBLE * (SELECT p FROM ev)) / (sum(lb) + {U.WEIGHT}::DOUBLE) AS p FROM no GROUP BY site),
px AS (SELECT host, node, site, bl, lb, i, node[1:i] AS branch FROM no, (SELECT unnest(range({U.DEPTH + 2})) AS i) WHERE i <= len(node)),
br AS (SELECT host, branch, sum(bl) AS bl, sum(lb) AS lb FROM px GROUP BY ALL),
ch AS (SELECT host, node, site, list([br.bl, br.lb] ORDER BY i) AS chain FROM px JOIN br USING (host, branch) GROUP BY ALL),
sh AS (SELECT host, node, list_reduce(list_concat([[p, 0.0::DOUBLE]], chain), lambda a, x: [(x[1] + {U.WEIGHT}::DOUBLE * a[1]) / (x[2] + {U.WEIGHT}::DOUBLE), 0.0::DOUBLE])[1] AS share, chain[len(chain)][2]::BIGINT AS labelled FROM ch JOIN st USING (site))
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN share > {U.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(node, '/') AS template, round(share, 6) AS share, labelled
FROM pl JOIN nm USING (host, tpl) JOIN sh USING (host, node)
"""


ORACLE_SQL = {"op12_path_template_tree": url_filters(), "op11_bitmap_rank_merkle": merkle(), "op2_setsketch_near_duplicates": NEAR_DUPLICATES, "op4_license_set_join": licenses()}
