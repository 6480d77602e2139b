"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in native expressions.

Candidates are found by one pattern, validated by their own rules (issuer ranges and Luhn for card numbers, mod 97 for
account numbers, calendar for dates, octets for addresses, ranges for social security numbers) and permuted within their
format by an unbalanced Feistel network with additive rounds, whose round function is SHA-256 of the key, the kind,
the round and the other half. Each permutation is a bijection of its format, so equal values keep one pseudonym in
all documents and different values of a format never meet:

* card: the issuer's first four digits stay, the others but the last are permuted, the check digit is made anew;
  separators stay.
* account (IBAN): letters within letters and digits within digits, then new check digits (02 to 98, as valid ones
  have); country and spaces stay.
* phone: all digits but the country code (the first one to three digits in a row after +). Found are numbers of 8 to 15
  digits after +, in groups of any size, and (NNN) NNN-NNNN or NNN-NNN-NNNN; other national forms without + are not.
* ssn: area, group and serial within their valid ranges.
* ip: 32 bits.
* date: day, month and year from 1900 to 2099, as YYYY-MM-DD or as two numbers of one or two digits and a year with
  / . or - between (days and months come out with two digits each). Dates with days up to 28 are one set, later days of
  all months and years, 29 February among them, are another: their running number is permuted, walking the cycle while
  it is beyond the last.
* email: letters and digits of an ASCII local part; any other local part becomes = and the permuted hexadecimal digits
  of its UTF-8 bytes, which no ASCII one can be. The domain stays.
* secret: hexadecimal runs of 32 to 64 after = or :, and 16 to 128 letters, digits and any of _ - + / . after a name that
  ends in key, secret, token, password, passwd or pwd and = or :.

Values that fail validation stay as they are. Everything runs in the JVM; texts without digit and @ are not searched.

The key is an argument or the session's setting ``spark.tritloom.pii.secret`` (Spark redacts settings of that name in its
logs); without either a random key is drawn for the call, so pseudonyms are linked within its result only. It is read
from a local one-row table by a subquery, so plans and event logs show its column but not its value.

Defined results: a null text stays null with no finds; an empty text stays empty; repeated rows each get their row; an
empty table gives an empty result; columns of the input named as ``into`` or ``found`` are replaced, all others stay.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
SETTING = "spark.tritloom.pii.secret"
#: First digits and lengths of card numbers.
ISSUERS = (
    r"4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}"
    r"|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12,15}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17}|(?:5[06-8]|6[0137])[0-9]{11,17}"
)

PATTERN = "|".join((
    r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+",
    r"(?<=[=:][^0-9A-Za-z\n]{0,8})[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    r"(?<=[=: \"'])(?=[0-9A-Za-z])(?<=[=:][ \"']{0,4})(?<=(?i:key|secret|token|password|passwd|pwd)[\"']{0,1} {0,3}[=:] {0,3}[\"']{0,1})(?=[A-Za-z_\-+/.]{0,127}[0-9])[0-9A-Za-z][0-9A-Za-z_\-+/.]{14,126}[0-9A-Za-z](?![0-9A-Za-z_\-+/.@])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])",
    r"(?<![0-9/.])(?:[0-9]{1,2}([/.])[0-9]{1,2}\1|(?<![0-9]-)[0-9]{1,2}-[0-9]{1,2}-(?=[0-9]{4}(?!-[0-9])))(?:19|20)[0-9]{2}(?![0-9])",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![0-9A-Za-z+])\+1[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z+])\+[0-9](?:[ .\-/()  ]{0,3}[0-9]){7,14}(?![0-9])",
    r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    r"(?<![0-9\-.])[0-9]{3}([\-.])[0-9]{3}\2[0-9]{4}(?![0-9\-])",
    r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\4[0-9]{5})(?![0-9A-Za-z])",
))


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """Builds the SQL of the permutations; ``v`` are SQL expressions."""

    def __init__(self, key: str, rounds: int = ROUNDS) -> None:
        """``key`` is an expression."""
        self.key, self.rounds = key, rounds

    def mac(self, kind: str, *v: str, bits: int = 256) -> str:
        return f"sha2(concat_ws('|', {self.key}, '{kind}', {', '.join(f'cast({x} as string)' for x in v)}), {bits})"

    def number(self, kind: str, *v: str) -> str:
        return f"cast(conv(substr({self.mac(kind, *v)}, 1, 15), 16, 10) as bigint)"

    def feistel(self, kind: str, left: str, right: str, left_size: str, right_size: str, out: str) -> str:
        """Two numbers below two sizes; ``out`` is an expression of p.l and p.r."""
        turn_l = f"(s.l + {self.number(kind, 'i', left_size, right_size, 's.r')}) % {left_size}"
        turn_r = f"(s.r + {self.number(kind, 'i', left_size, right_size, 's.l')}) % {right_size}"
        return (
            f"aggregate(sequence(0, {self.rounds - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), "
            f"(s, i) -> if(i % 2 = 0, named_struct('l', {turn_l}, 'r', s.r), named_struct('l', s.l, 'r', {turn_r})), p -> {out})"
        )

    def digits(self, kind: str, d: str) -> str:
        """A string of 2 to 36 digits to another of its length."""
        a, b = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
        power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
        out = f"concat(lpad(cast(p.l as string), {a}, '0'), lpad(cast(p.r as string), {b}, '0'))"
        return self.feistel(kind, f"substr({d}, 1, {a})", f"substr({d}, {a} + 1)", power(a), power(b), out)

    def chars(self, kind: str, x: str, letters: int = 26) -> str:
        """A string to another with digits and letters of either case in the same places."""
        a = f"(length({x}) div 2)"

        def turned(half: str, mac: str) -> str:
            byte = f"cast(conv(substr({mac}, 2 * ((j - 1) % 64) + 1, 2), 16, 10) as int)"
            c = f"substr({half}, j, 1)"
            shift = lambda first, n: f"char({first} + (ascii({c}) - {first} + {byte}) % {n})"
            last_low, last_up = chr(96 + letters), chr(64 + letters)
            one = f"case when {c} between '0' and '9' then {shift(48, 10)} when {c} between 'a' and '{last_low}' then {shift(97, letters)} when {c} between 'A' and '{last_up}' then {shift(65, letters)} else {c} end"
            return f"if(length({half}) = 0, '', array_join(transform(sequence(1, greatest(1, length({half}))), j -> {one}), ''))"

        mac = lambda other: self.mac(kind, "i", f"length({x})", other, bits=512)
        return (
            f"aggregate(sequence(0, {self.rounds - 1}), named_struct('l', substr({x}, 1, {a}), 'r', substr({x}, {a} + 1)), "
            f"(s, i) -> if(i % 2 = 0, named_struct('l', {turned('s.l', mac('s.r'))}, 'r', s.r), named_struct('l', s.l, 'r', {turned('s.r', mac('s.l'))})), p -> concat(p.l, p.r))"
        )


def _luhn(d: str) -> str:
    """The Luhn sum of a string of digits."""
    digit = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0)))"


def _mod97(x: str) -> str:
    """The remainder of an account number with its letters as numbers, country and check digits moved to the end."""
    c = f"substr({x}, k, 1)"
    value = f"if({c} between '0' and '9', t * 10 + ascii({c}) - 48, t * 100 + ascii({c}) - 55)"
    return f"aggregate(sequence(1, length({x})), 0, (t, k) -> cast(({value}) % 97 as int))"


def _refilled(m: str, chars: str, of: str) -> str:
    """``m`` with its characters of the class ``of`` taken from ``chars`` in order."""
    c = f"substr({m}, k, 1)"
    return (
        f"aggregate(sequence(1, length({m})), named_struct('o', '', 'n', 1), (t, k) -> if({c} rlike '{of}', "
        f"named_struct('o', concat(t.o, substr({chars}, t.n, 1)), 'n', t.n + 1), named_struct('o', concat(t.o, {c}), 'n', t.n)), t -> t.o)"
    )


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _last_day(month: str, year: str) -> str:
    return f"(case when {month} in (4, 6, 9, 11) then 30 when {month} = 2 then if({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0), 29, 28) else 31 end)"


#: Months in order of their late days, for the running number of a late date: 29 to 31 of each month but February.
_LATE = [(m, d) for m in range(1, 13) for d in range(29, 32) if m != 2 and (d < 31 or m not in (4, 6, 9, 11))]
_YEARS, _LEAPS = 200, 49


def _late_date(sql: _Sql, year: str, month: str, day: str, out: str) -> str:
    """A valid date of day 29 to 31 to another; ``out`` is an expression of the new y, a (month) and b (day).

    Late dates are numbered by year and place in ``_LATE``, then 29 February by leap year; 77 * 76 is the least such
    rectangle that holds them, with three numbers over, so four steps along a cycle always reach a date.
    """
    n = _YEARS * len(_LATE) + _LEAPS
    places = "array(" + ", ".join(str(100 * m + d) for m, d in _LATE) + ")"
    number = f"if({month} = 2, {_YEARS * len(_LATE)} + ({year} - 1904) div 4, ({year} - 1900) * {len(_LATE)} + array_position({places}, 100 * {month} + {day}) - 1)"
    step = sql.feistel("late", "(w div 76)", "(w % 76)", "77", "76", "p.l * 76 + p.r")
    walked = f"aggregate(sequence(0, 3), struct(cast({number} as bigint) as w, false as done), (u, t) -> if(u.done, u, {_let('w', 'u.w', _let('x', step, f'struct(x as w, x < {n} as done)'))}), u -> u.w)"
    back = f"if(x >= {_YEARS * len(_LATE)}, struct(1904 + 4 * (x - {_YEARS * len(_LATE)}) as y, 229 as at), struct(1900 + x div {len(_LATE)} as y, {places}[cast(x % {len(_LATE)} as int)] as at))"
    return _let("x", walked, _let("n", back, _let("y", "n.y", _let("a", "n.at div 100", _let("b", "n.at % 100", out)))))


def _two(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


def pseudonym_sql(key: str, rounds: int = ROUNDS) -> str:
    """SQL of (kind, new) for a match ``m``; kind is null and new is ``m`` where validation fails. ``key``: an expression."""
    sql = _Sql(key, rounds)
    done = lambda kind, ok, new: f"if({ok}, named_struct('kind', '{kind}', 'new', {new}), named_struct('kind', cast(null as string), 'new', m))"

    foreign = _let("z", "lower(hex(encode(x, 'UTF-8')))", f"concat('=', {sql.chars('email=', 'z', 6)})")
    local = _let("x", "substring_index(m, '@', 1)", f"if(x rlike '^[\\\\x00-\\\\x7F]*$', {sql.chars('email', 'x')}, {foreign})")
    email = done("email", "true", f"concat({local}, substr(m, instr(m, '@')))")
    secret = done("secret", "true", sql.chars("secret", "m", 6))
    token = done("secret", "true", sql.chars("token", "m"))

    flat = "replace(m, ' ', '')"
    checked = lambda x: f"concat({x}, '00')"
    body = sql.chars("iban", "substr(x, 5)")
    digits_for = f"lpad(cast(98 - {_mod97('z')} as string), 2, '0')"
    new_account = _let("y", body, _let("z", "concat(y, substr(x, 1, 2), '00')", f"concat(substr(x, 1, 2), {digits_for}, y)"))
    account = _let("x", flat, done("account", f"length(x) between 15 and 34 and substr(x, 3, 2) between '02' and '98' and {_let('z', 'concat(substr(x, 5), substr(x, 1, 4))', _mod97('z'))} = 1", _let("w", new_account, _refilled("m", "w", "[0-9A-Z]"))))

    y, a, b = (f"cast(substr(m, {k}, {n}) as int)" for k, n in ((1, 4), (6, 2), (9, 2)))
    iso_early = sql.feistel("date", "(a - 1) * 28 + b - 1", "y - 1900", "336", "200", f"concat(cast(1900 + p.r as string), '-', {_two('p.l div 28 + 1')}, '-', {_two('p.l % 28 + 1')})")
    iso_late = _late_date(sql, "y", "a", "b", f"concat(cast(y as string), '-', {_two('a')}, '-', {_two('b')})")
    iso = _let("y", y, _let("a", a, _let("b", b, done("date", f"a between 1 and 12 and b between 1 and {_last_day('a', 'y')}", f"if(b <= 28, {iso_early}, {iso_late})"))))

    y, a, b = (f"cast(split(m, '[-/.]')[{k}] as int)" for k in (2, 0, 1))
    sep = "substr(m, length(m) - 4, 1)"
    month, day = "least(a, b)", "greatest(a, b)"
    either = sql.feistel("day", "(a - 1) * 12 + b - 1", "y - 1900", "144", "200", f"concat({_two('p.l div 12 + 1')}, {sep}, {_two('p.l % 12 + 1')}, {sep}, cast(1900 + p.r as string))")
    one = lambda first, second: f"concat({_two(first)}, {sep}, {_two(second)}, {sep}, cast(1900 + p.r as string))"
    new_month, new_day = "p.l div 16 + 1", "p.l % 16 + 13"
    known = sql.feistel("day", f"({month} - 1) * 16 + {day} - 13", "y - 1900", "192", "200", f"if(a > b, {one(new_day, new_month)}, {one(new_month, new_day)})")
    joined = lambda *parts: "concat(" + f", {sep}, ".join(parts) + ")"
    new_year = "cast(y as string)"
    late = _let("f", "a > b", _late_date(sql, "y", month, day, f"if(f, {joined(_two('b'), _two('a'), new_year)}, {joined(_two('a'), _two('b'), new_year)})"))
    slash = _let("y", y, _let("a", a, _let("b", b, done("date", f"{month} between 1 and 12 and {day} <= {_last_day(month, 'y')}", f"case when {day} <= 12 then {either} when {day} <= 28 then {known} else {late} end"))))

    octets = "transform(split(m, '[.]'), t -> cast(t as int))"
    dotted = "concat_ws('.', cast(p.l div 256 as string), cast(p.l % 256 as string), cast(p.r div 256 as string), cast(p.r % 256 as string))"
    ip = _let("o", octets, done("ip", "array_max(o) <= 255", sql.feistel("ip", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", dotted)))

    prefix = "regexp_extract(m, '^([+][0-9]{1,3})?', 0)"
    phone = _let("c", prefix, _let("d", "regexp_replace(substr(m, length(c) + 1), '[^0-9]', '')", done("phone", "true", f"concat(c, {_let('w', sql.digits('phone', 'd'), _let('r', 'substr(m, length(c) + 1)', _refilled('r', 'w', '[0-9]')))})")))

    area, group, serial = (f"cast(substr(m, {k}, {n}) as int)" for k, n in ((1, 3), (5, 2), (8, 4)))
    new_area = "(p.l div 99 + if(p.l div 99 < 665, 1, 2))"
    ssn_new = sql.feistel("ssn", "(a - if(a < 666, 1, 2)) * 99 + b - 1", "y - 1", "88902", "9999", f"concat(lpad(cast({new_area} as string), 3, '0'), '-', {_two('p.l % 99 + 1')}, '-', lpad(cast(p.r + 1 as string), 4, '0'))")
    ssn = _let("a", area, _let("b", group, _let("y", serial, done("ssn", "a between 1 and 899 and a <> 666 and b > 0 and y > 0", ssn_new))))

    fresh = _let("e", f"concat(substr(d, 1, 4), {_let('g', 'substr(d, 5, length(d) - 5)', sql.digits('card', 'g'))})", _let("f", "concat(e, '0')", f"concat(e, cast((10 - {_luhn('f')} % 10) % 10 as string))"))
    card = _let("d", "regexp_replace(m, '[^0-9]', '')", done("card", f"d rlike '^(?:{ISSUERS})$' and {_luhn('d')} % 10 = 0", _let("w", fresh, _refilled("m", "w", "[0-9]"))))

    return (
        f"case when instr(m, '@') > 0 then {email} when m rlike '^[0-9A-Fa-f]{{32,64}}$' then {secret} when m rlike '^[A-Z]{{2}}[0-9]{{2}}' then {account} "
        f"when m rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {iso} when m rlike '^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}$' then {slash} "
        f"when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {ip} when m rlike '^[+(]|^[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$' then {phone} "
        f"when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} when m rlike '[A-Za-z]' then {token} else {card} end"
    )


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str | None = None, into: str = "text", found: str = "pii_kinds") -> DataFrame:
    """``docs`` with ``into``: the text with pseudonyms, and ``found``: the kinds replaced, in order of place."""
    spark = docs.sparkSession
    key = key or spark.conf.get(SETTING, None) or secrets.token_hex(32)
    column = "`" + text.replace("`", "``") + "`"
    pattern = _lit(PATTERN)
    keyed = docs.withColumn("__key", spark.createDataFrame([(key,)], "key string").scalar())
    finds = f"if({column} rlike '[0-9@]', transform(regexp_extract_all({column}, {pattern}, 0), m -> {pseudonym_sql('__key')}), array())"
    with_finds = keyed.withColumn("__finds", F.expr(finds))
    parts = f"zip_with(split({column}, {pattern}, -1), __finds, (x, y) -> concat(x, coalesce(y.new, '')))"
    kinds = F.filter(F.transform("__finds", lambda x: x["kind"]), lambda x: x.isNotNull())
    changed = with_finds.withColumn(found, F.coalesce(kinds, F.array().cast("array<string>")))
    changed = changed.withColumn(into, F.expr(f"if(size(__finds) > 0, array_join({parts}, ''), {column})"))
    return changed.drop("__finds", "__key")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", F.size("pii_kinds").cast("bigint").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))
