"""Format-preserving pseudonyms for personal data, with DataFrame and SQL functions only.

Validated values are permuted by a keyed Feistel network inside the set of values of their own
format, so equal values stay equal in all documents and different ones different:

* card numbers (13-19 digits, valid check digit): all digits but the first; the check digit is
  made anew;
* phone numbers of ten digits in the groups usual in North America: these, behind the country code;
* social security numbers: area, group and serial inside their valid ranges;
* dates from 1900 to 2099 (2024-01-31, 31.01.2024, 01/31/2024, 31/01/2024): the day, in the same notation;
* addresses a.b.c.d: 32 bits;
* mail addresses: letters stay letters and digits digits in the local part; the domain stays.

Half A (of ``ra`` values) and half B (of ``rb``) take turns: A + F(round, B) mod ra, then
B + F(round, A) mod rb. Any ra and rb will do, so no value is walked out of its domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind -> pattern, tried in this order.
PATTERNS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "address": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A text without this has nothing to find.
HINT = r"@|[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]"


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind: str, v: str) -> str:
    return f"{v} rlike {_text('^(?:' + PATTERNS[kind] + ')$')}"


def feistel(a: str, b: str, ra: str, rb: str, tweak: str, key: str) -> str:
    """SQL of a struct (a, b): the permuted halves."""

    def f(x: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, {tweak}, i, {x}), 256), 1, 14), 16, 10) as bigint)"

    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('a', (s.a + {f('s.b')}) % cast({ra} as bigint), 'b', s.b), "
        f"named_struct('a', s.a, 'b', (s.b + {f('s.a')}) % cast({rb} as bigint))))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digits(d: str, tweak: str, key: str) -> str:
    """SQL: a string of 2 to 18 digits, permuted."""
    left, right = f"length({d}) div 2", f"length({d}) - length({d}) div 2"
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    halves = feistel(f"substr({d}, 1, {left})", f"substr({d}, 1 + {left})", power(left), power(right), f"concat({tweak}, length({d}))", key)
    return _let("h", halves, f"concat(lpad(cast(h.a as string), {left}, '0'), lpad(cast(h.b as string), {right}, '0'))")


def _bare(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _refill(v: str, new: str) -> str:
    """SQL: the text v, its digits replaced in order by those of ``new``."""
    return (
        f"array_join(transform(sequence(1, length({v})), i -> if(substr({v}, i, 1) rlike '[0-9]', "
        f"substr({new}, length({_bare(f'substr({v}, 1, i)')}), 1), substr({v}, i, 1))), '')"
    )


def luhn_sum(d: str, skip: int) -> str:
    """SQL: sum of the digits of d, every other doubled; skip = 1 if the check digit is missing."""
    x = "cast(substr(reverse(" + d + "), i, 1) as int)"
    return (
        f"aggregate(transform(sequence(1, length({d})), i -> if((i + {skip}) % 2 = 0, {x} * 2 - if({x} > 4, 9, 0), {x})), 0, (t, y) -> t + y)"
    )


def _card(v: str, key: str) -> str:
    body = f"concat(substr(d, 1, 1), {digits('substr(d, 2, length(d) - 2)', _text('card'), key)})"
    full = _let("p", body, f"concat(p, cast((10 - {luhn_sum('p', 1)} % 10) % 10 as string))")
    return _let("d", _bare(v), f"if({luhn_sum('d', 0)} % 10 = 0, {_let('n', full, _refill(v, 'n'))}, {v})")


def _phone(v: str, key: str) -> str:
    new = f"concat(substr(d, 1, length(d) - 10), {digits('right(d, 10)', _text('phone'), key)})"
    return _let("d", _bare(v), _let("n", new, _refill(v, "n")))


def _ssn(v: str, key: str) -> str:
    # Valid: area 001-899 but 666, group 01-99, serial 0001-9999.
    area, group, serial = (f"cast(substr(d, {at}, {n}) as int)" for at, n in ((1, 3), (4, 2), (6, 4)))
    halves = feistel(f"{area} - if({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", _text("ssn"), key)
    out = "concat_ws('-', lpad(cast(h.a + if(h.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(h.b div 9999 + 1 as string), 2, '0'), lpad(cast(h.b % 9999 + 1 as string), 4, '0'))"
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    return _let("d", _bare(v), f"if({valid}, {_let('h', halves, out)}, {v})")


#: Days of 1900-2099 behind the twelfth of their month, and a grid that holds their numbers.
LATE_DAYS, GRID = 44_249, (211, 210)


def _late(x: str) -> str:
    """SQL: the date with number x among the days behind the twelfth. Every month before leaves out twelve."""
    start = "add_months(date'1900-01-01', k)"
    before = f"datediff({start}, date'1900-01-01') - 12 * k"
    near = f"sequence(greatest({x} * 2400 div {LATE_DAYS} - 4, 0), least({x} * 2400 div {LATE_DAYS} + 4, 2399))"
    found = f"array_max(transform(filter({near}, k -> {before} <= {x}), k -> cast(k as int)))"
    return f"element_at(transform(array({found}), k -> date_add({start}, cast(12 + {x} - ({before}) as int))), 1)"


def _date(v: str, key: str) -> str:
    """Dates are permuted among the strings that are read alike. A string with slashes is month, day, year
    if that is a date; day, month, year is read only where the day is behind the twelfth, so it is
    permuted among those days (numbers outside them are permuted again, at most once each)."""
    # 73,049 = 17 * 4,297 days.
    day = "datediff(t, date'1900-01-01')"
    halves = feistel(f"{day} div 4297", f"{day} % 4297", "17", "4297", _text("date"), key)
    form = f"case when {v} like '____-%' then 'yyyy-MM-dd' when {v} like '__.%' then 'dd.MM.yyyy' else 'MM/dd/yyyy' end"
    shown = _let("h", halves, f"date_format(date_add(date'1900-01-01', cast(h.a * 4297 + h.b as int)), {form})")
    ra, rb = GRID
    again = _let("h", feistel(f"x div {rb}", f"x % {rb}", str(ra), str(rb), _text("late date"), key), f"h.a * {rb} + h.b")
    first = f"cast(datediff(u, date'1900-01-01') - 12 * ((year(u) - 1900) * 12 + month(u)) as bigint)"
    walked = f"aggregate(sequence(0, {ra * rb - LATE_DAYS}), {first}, (x, j) -> if(j = 0 or x >= {LATE_DAYS}, {again}, x))"
    late = _let("y", walked, f"date_format({_late('y')}, 'dd/MM/yyyy')")
    within = "between date'1900-01-01' and date'2099-12-31'"
    other = _let("u", f"if({v} like '__/%', cast(try_to_timestamp({v}, 'dd/MM/yyyy') as date), null)", f"if(u {within}, {late}, {v})")
    return _let("t", f"cast(try_to_timestamp({v}, {form}) as date)", f"if(t is null, {other}, if(t {within}, {shown}, {v}))")


def _address(v: str, key: str) -> str:
    part = lambda i: f"cast(split({v}, '[.]')[{i}] as int)"
    halves = feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", _text("address"), key)
    return _let("h", halves, "concat_ws('.', h.a div 256, h.a % 256, h.b div 256, h.b % 256)")


def _mail(v: str, key: str) -> str:
    """Runs of up to 20 characters of the local part, each in the alphabet of each character."""
    radix = "case when c rlike '[0-9]' then 10 when c rlike '[A-Za-z]' then 26 else 1 end"
    value = "case when c rlike '[0-9]' then ascii(c) - 48 when c rlike '[a-z]' then ascii(c) - 97 when c rlike '[A-Z]' then ascii(c) - 65 else 0 end"
    sized = lambda xs: f"aggregate({xs}, cast(1 as bigint), (m, c) -> m * ({radix}))"
    number = lambda xs: f"aggregate({xs}, cast(0 as bigint), (m, c) -> m * ({radix}) + ({value}))"
    first = "case when c rlike '[0-9]' then 48 when c rlike '[a-z]' then 97 else 65 end"

    def written(xs: str, x: str) -> str:
        step = f"named_struct('r', m.r div ({radix}), 'o', concat(if(({radix}) = 1, c, chr({first} + m.r % ({radix}))), m.o))"
        return f"aggregate(reverse({xs}), named_struct('r', {x}, 'o', ''), (m, c) -> {step}, m -> m.o)"

    low, high = "slice(w, 1, 10)", "slice(w, 11, 10)"
    halves = feistel(number(low), number(high), sized(low), sized(high), "concat('mail', k, array_join(transform(w, c -> cast((" + radix + ") as string)), ''))", key)
    run = _let("w", "split(substr(l, k * 20 + 1, 20), '')", _let("h", halves, f"concat({written(low, 'h.a')}, {written(high, 'h.b')})"))
    local = f"array_join(transform(sequence(0, (length(l) - 1) div 20), k -> {run}), '')"
    return _let("l", f"substring_index({v}, '@', 1)", f"concat({local}, substr({v}, length(l) + 1))")


def pseudonym(v: str, key: str) -> str:
    """SQL of the pseudonym of the found text ``v``; what is not valid stays as it is."""
    makers = {"mail": _mail, "phone": _phone, "address": _address, "date": _date, "ssn": _ssn, "card": _card}
    cases = " ".join(f"when {_is(kind, v)} then {make(v, key)}" for kind, make in makers.items())
    return f"case {cases} else {v} end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with ``text`` pseudonymised and __found, the number of values changed.

    Null texts stay null with 0 found, and texts of any length are read whole. Rows are taken one
    by one, so repeated rows give repeated rows; other columns stay as they are.
    """
    found, gaps = f"regexp_extract_all(__text, {_text(ANY)}, 0)", f"split(__text, {_text(ANY)}, -1)"
    new = f"transform({found}, v -> {pseudonym('v', key)})"
    hinted = docs.withColumn("__text", F.expr(f"if(`{text}` rlike {_text(HINT)}, `{text}`, null)"))
    got = hinted.withColumn("__new", F.expr(f"if(__text is null, null, {new})"))
    changed = f"size(filter(zip_with(__new, {found}, (x, y) -> x <> y), z -> z))"
    joined = f"array_join(flatten(zip_with({gaps}, __new, (g, x) -> array(g, coalesce(x, '')))), '')"
    return (
        got.withColumn("__found", F.expr(f"coalesce(if(size(__new) > 0, {changed}, 0), 0)"))
        .withColumn(text, F.expr(f"if(__found > 0, {joined}, `{text}`)"))
        .drop("__text", "__new")
    )


def stage(docs: DataFrame, key: str) -> DataFrame:
    return pseudonymise(docs, key).select(*[f"`{c}`" for c in docs.columns])
