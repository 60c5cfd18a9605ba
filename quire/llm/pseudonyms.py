"""Format-preserving pseudonyms: a keyed Feistel permutation maps each valid value to one of the same format.

Equal values get equal pseudonyms in all documents, and with the key they can be turned back. Found are payment card
numbers (13 to 19 digits, blanks or hyphens between groups, valid check digit), phone numbers, IPv4 addresses (octets to 255),
social security numbers (ddd-dd-dddd), calendar dates (yyyy-mm-dd or yyyy/mm/dd, 1800 to 2199) and e-mail addresses (their local part).
A number that fails its validation stays as it is; of a card number with other groups of digits behind it, the longest valid part is taken. All is done with SQL functions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a walk at most; at worst half of the steps end it, so one in 2^64 would go on.
WALK = 64
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = rf"(?:\+|{_EDGE})[0-9]{{1,3}}[ -]?\([0-9]{{3}}\) ?[0-9]{{3}}[ -][0-9]{{4}}{_END}|(?:\([0-9]{{3}}\) ?|{_EDGE}[0-9]{{3}}[-. ])[0-9]{{3}}[-. ][0-9]{{4}}{_END}"
IPV4 = rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])"
SSN = rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])"
DATE = r"(?<![0-9A-Za-z/-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9/-]|[A-SU-Za-z])"
CARD = rf"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9A-Za-z])"
ANY = "|".join([EMAIL, PHONE, SSN, DATE, IPV4, CARD])
_DAYS, _A, _B = 146097, 189, 773  # days of 400 years, and their two factors


def _keyed(key: str) -> str:
    """The key as hex, so that any text may be a key inside SQL."""
    return hashlib.sha256(key.encode()).hexdigest()


def _noise(key: str, *parts: str) -> str:
    return f"cast(conv(substring(sha2(concat_ws(':', '{key}', {', '.join(parts)}), 256), 1, 14), 16, 10) AS bigint)"


def _order(back: bool) -> str:
    return f"sequence({ROUNDS}, 1, -1)" if back else f"sequence(1, {ROUNDS})"


def _chars(value: str, tag: str, key: str, back: bool) -> str:
    """Feistel over characters: in each round those at odd or at even places move within their kind by a keyed hash of the others."""
    sign = "-" if back else "+"
    other = "array_join(transform(sequence(1, length(t)), j -> if(j % 2 = r % 2, '', substring(t, j, 1))), '')"

    def moved(first: int, size: int) -> str:
        return f"chr({first} + pmod(ascii(c) - {first} {sign} {_noise(key, repr(tag), 'r', 'i', 'o')}, {size}))"

    move = f"CASE WHEN c BETWEEN '0' AND '9' THEN {moved(48, 10)} WHEN c BETWEEN 'a' AND 'z' THEN {moved(97, 26)} WHEN c BETWEEN 'A' AND 'Z' THEN {moved(65, 26)} ELSE c END"
    one = f"if(i % 2 <> r % 2, substring(t, i, 1), transform(array(substring(t, i, 1)), c -> {move})[0])"
    step = f"transform(array({other}), o -> array_join(transform(sequence(1, length(t)), i -> {one}), ''))[0]"
    return f"if(length({value}) = 0, '', aggregate({_order(back)}, {value}, (t, r) -> {step}))"


def _pair(left: str, right: str, a: str, b: str, tag: str, key: str, back: bool) -> str:
    """Feistel over a pair (left below a, right below b)."""
    sign = "-" if back else "+"
    step = f"if(r % 2 = 1, named_struct('l', pmod(s.l {sign} {_noise(key, repr(tag), 'r', 's.r')}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r {sign} {_noise(key, repr(tag), 'r', 's.l')}, {b})))"
    return f"aggregate({_order(back)}, named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, r) -> {step})"


def _refilled(value: str, digits: str) -> str:
    """A value with its digits replaced in order; all else stays."""
    nth = "length(regexp_replace(substring(v, 1, k), '[^0-9]', ''))"
    return f"transform(array(named_struct('v', {value}, 'd', {digits})), q -> array_join(transform(sequence(1, length(q.v)), k -> if(substring(q.v, k, 1) BETWEEN '0' AND '9', substring(q.d, {nth.replace('(v', '(q.v')}, 1), substring(q.v, k, 1))), ''))[0]"


def _luhn(digits: str) -> str:
    """The check sum of digits that lack their check digit."""
    return f"aggregate(sequence(1, length({digits})), 0, (z, k) -> z + transform(array(cast(substring({digits}, -k, 1) AS int) * (1 + k % 2)), w -> if(w > 9, w - 9, w))[0])"


def _check_digit(digits: str) -> str:
    return f"cast(pmod(10 - {_luhn(digits)} % 10, 10) AS string)"


def _card_end(text: str) -> str:
    """SQL for where the longest valid card number at a text's start ends: 13 digits at least, before a blank, a hyphen or the end; null without one."""
    valid = f"transform(array(substring(p, 1, length(p) - 1)), y -> right(p, 1) = {_check_digit('y')})[0]"
    ends = f"(u = length(f) OR substring(f, u + 1, 1) IN (' ', '-')) AND transform(array(regexp_replace(substring(f, 1, u), '[^0-9]', '')), p -> if(length(p) >= 13, {valid}, false))[0]"
    return f"transform(array({text}), f -> get(filter(sequence(greatest(length(f), 13), 13, -1), u -> substring(f, u, 1) BETWEEN '0' AND '9' AND {ends}), 0))[0]"


def _card(m: str, key: str, back: bool) -> str:
    """The longest valid card number at a match's start replaced, the rest as it stands. Where digits follow, the permutation is walked on until
    the longest valid number ends at the same place again, so that the way back finds it there."""
    plain = "regexp_replace(h, '[^0-9]', '')"
    step = f"transform(array({_chars(f'substring({plain}, 1, length({plain}) - 1)', 'card', key, back)}), g -> {_refilled('h', f'concat(g, {_check_digit("g")})')})[0]"
    first = f"transform(array(s.head), h -> {step})[0]"
    walked = f"aggregate(sequence(1, {WALK}), {first}, (h, n) -> if({_card_end('concat(h, s.rest)')} <=> s.at, h, {step}))"
    cut = f"transform(array({_card_end(m)}), e -> named_struct('at', e, 'head', substring({m}, 1, e), 'rest', substring({m}, e + 1)))"
    return f"transform({cut}, s -> if(s.at IS NULL, {m}, if(s.rest = '', {first}, concat({walked}, s.rest))))[0]"


def _pseudonym(m: str, key: str, back: bool) -> str:
    """SQL for the pseudonym of one match; the match itself where validation fails."""
    plain = f"regexp_replace({m}, '[^0-9]', '')"
    card = _card(m, key, back)
    last = f"right({plain}, 10)"
    phone = _refilled(m, f"concat(left({plain}, length({plain}) - 10), {_chars(last, 'phone', key, back)})")
    ssn = _refilled(m, _chars(plain, "ssn", key, back))
    octet = [f"cast(split({m}, '[.]')[{k}] AS int)" for k in range(4)]
    pair = _pair(f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", "65536", "65536", "ip", key, back)
    ip = f"transform(array({pair}), g -> concat_ws('.', g.l div 256, g.l % 256, g.r div 256, g.r % 256))[0]"
    ip = f"if({' AND '.join(f'{o} <= 255' for o in octet)}, {ip}, {m})"
    day = f"datediff(try_cast(replace({m}, '/', '-') AS date), DATE'1800-01-01')"
    moved = f"transform(array({_pair(f'{day} div {_B}', f'{day} % {_B}', str(_A), str(_B), 'date', key, back)}), g -> date_format(date_add(DATE'1800-01-01', cast(g.l * {_B} + g.r AS int)), 'yyyy-MM-dd'))[0]"
    date = f"if({day} BETWEEN 0 AND {_DAYS - 1}, if({m} LIKE '%/%', replace({moved}, '-', '/'), {moved}), {m})"
    mail = f"concat({_chars(f'substring_index({m}, {chr(39)}@{chr(39)}, 1)', 'mail', key, back)}, '@', substring_index({m}, '@', -1))"
    is_ip, is_date, is_ssn = "^[0-9]{1,3}([.][0-9]{1,3}){3}$", "^[0-9]{4}([-/])[0-9]{2}[-/][0-9]{2}$", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
    return f"CASE WHEN {m} LIKE '%@%' THEN {mail} WHEN {m} RLIKE '{is_ip}' THEN {ip} WHEN {m} RLIKE '{is_date}' THEN {date} WHEN {m} RLIKE '{is_ssn}' THEN {ssn} WHEN length({plain}) >= 13 AND {m} NOT LIKE '%(%' THEN {card} ELSE {phone} END"


def pseudonymise(text: str, key: str, back: bool = False) -> tuple[Column, Column]:
    """(new text, number of values that changed) of a text column; back=True turns pseudonyms into the values again."""
    found, gaps = f"regexp_extract_all(`{text}`, '{_quoted(ANY)}', 0)", f"split(`{text}`, '{_quoted(ANY)}', -1)"
    changed = F.expr(f"transform({found}, m -> {_pseudonym('m', _keyed(key), back)})")
    return F.when(F.col(text).rlike("[0-9@]"), changed), F.when(F.col(text).rlike("[0-9@]"), F.expr(f"struct({found} AS found, {gaps} AS gaps)"))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def pseudonymise_documents(docs: DataFrame, key: str, back: bool = False, count: str = "n_values") -> DataFrame:
    """docs(text, ...) with text's personal values replaced and a column with the number of values replaced.

    Who knows the key can turn pseudonyms back, so there is no default. All other columns come back as they are; one named as the count is replaced. A null text stays null with
    a count of 0; texts without such values stay as they are. Rows are handled one by one, so repeats and ties need no rule
    and an empty table gives an empty one.
    """
    names = [n for n in docs.columns if n != count]
    work, parts = "_quire_new", "_quire_parts"
    new, cut = pseudonymise("text", key, back)
    rows = docs.withColumn(parts, cut).withColumn(work, new)
    text = F.expr(f"concat({parts}.gaps[0], array_join(zip_with({work}, slice({parts}.gaps, 2, greatest(size({parts}.gaps) - 1, 0)), (m, g) -> concat(m, g)), ''))")
    changed = F.expr(f"size(filter(zip_with({work}, {parts}.found, (a, b) -> a <> b), x -> x))")
    has = F.col(work).isNotNull()
    rows = rows.withColumns({count: F.when(has, changed).otherwise(0), "text": F.when(has, text).otherwise(F.col("text"))})
    return rows.select(*[F.col(f"`{n}`") for n in names], count)
