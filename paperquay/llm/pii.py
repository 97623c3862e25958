"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Personal values are found by pattern, validated, and replaced by another value of the same format:
a keyed permutation of the format's values. The same value becomes the same pseudonym in every
document, and different values of a format never meet. A text is split at its values, the values
are permuted, and both are put together again.

Numbers with check digits or ranges count as values only if these hold: cards the Luhn digit, bank
numbers mod 97 and the length of their country, tax ids the ranges that are given out. Others stay.
Pseudonyms of valid values are valid.

Every value is first brought to a list of places, each with the number of symbols it can hold: 10 for
a digit, 26 for a letter, 256 for a part of an address, and so on. One Feistel network permutes such lists,
whatever their format: each round shifts the places of one half by a keyed hash of the other half. The
value is then put together again by its format. Capital letters of an e-mail address are folded first and
put back at their places, so addresses that differ in case only stay linked.

The secret is a one-row table that is read when the query runs; no plan holds it. The functions
below return SQL text, which Spark reads at once.
"""

from __future__ import annotations

from itertools import count as counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperquay.llm.common import renamed, restored

ROUNDS = 6
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters of bank numbers by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{'|'.join(who.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, who in IBAN_LENGTHS.items())
#: Formats, in the order in which they are tried at a place. None has a group of its own.
FORMATS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "address": f"(?<![A-Za-z0-9.]){OCTET}(?:[.]{OCTET}){{3}}(?![A-Za-z0-9]|[.][0-9])",
    "iso_date": "(?<![A-Za-z0-9/.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9])",
    "day_date": "(?<![A-Za-z0-9/.-])[0-9]{2}(?:/[0-9]{2}/|[.][0-9]{2}[.]|-[0-9]{2}-)[0-9]{4}(?![A-Za-z0-9])",
    "phone": "(?<![A-Za-z0-9.])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "tax_id": "(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "iban": "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + _IBANS + ")(?![A-Za-z0-9])",
    "number": "(?<![A-Za-z0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "key": "(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
}
#: How a match of these formats is told from others; what is none of them is a run of digits.
KINDS = {
    "email": "@", "address": "^[0-9]+(?:[.][0-9]+){3}$", "iso": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "day": "^[0-9]{2}([/.-])[0-9]{2}\\1[0-9]{4}$",
    "tax": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": "^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$", "iban": "^[A-Z]{2}[0-9]", "key": "^AKIA",
    "hex": "^[0-9a-f]{32,64}$",
}
#: Characters of a run that are looked at from a group on: more than any value in it has.
WINDOW = 64
#: Groups of digits, 13 digits or more, in which card-like numbers and other values are looked for.
RUN = "(?<![A-Za-z0-9.])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z0-9])(?:[ -][0-9]++(?![A-Za-z0-9]))*+"
#: Groups as cards have them.
GROUPS = (
    "[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,3}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
)
ANY = "|".join(f"(?:{x})" for x in [*(v for k, v in FORMATS.items() if k != "number"), RUN])
#: Areas of tax ids are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999. Those of persons without
#: a social security number have areas from 900 and groups 50 to 65, 70 to 88, 90 to 92 and 94 to 99.
TAX_ID = "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
TAX_GROUPS = [*range(50, 66), *range(70, 89), *range(90, 93), *range(94, 100)]
TAX_ID_9 = f"^9[0-9]{{2}}-(?:{'|'.join(map(str, TAX_GROUPS))})-[0-9]{{4}}$"
#: Last label of an e-mail address, which stays.
LAST_LABEL = "[.][A-Za-z0-9-]+$"
#: Days of the calendar's 400-year cycle, 1800-01-01 to 2199-12-31: 189 * 773.
FIRST_DAY, DAY_HALVES = "1800-01-01", (189, 773)

_NAMES = counter()


def _name() -> str:
    """A lambda variable that no other expression has."""
    return f"v{next(_NAMES)}"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, use) -> str:
    """``use(value)`` with the value worked out once."""
    v = _name()
    return f"transform(array({value}), {v} -> {use(v)})[0]"


def _case(of: str, choices: dict[str, str], otherwise: str) -> str:
    """``choices`` by the value of ``of``; names with a blank between them share a choice."""
    tests = (f"when {of} in ({', '.join(map(_quoted, k.split()))}) then {v}" for k, v in choices.items())
    return f"case {' '.join(tests)} else {otherwise} end"


def permuted(places: str, sizes: str, tweak: str, secret: str = "secret") -> str:
    """``places`` (array of int, each below its size) as another such array, by a Feistel network.

    A round shifts the left half by a keyed hash of the right one and changes sides; after an even
    number of rounds every place is where it was.
    """
    s, r, x, i = (_name() for _ in range(4))
    half = f"int(size({places}) / 2)"
    start = f"named_struct('l', slice({places}, 1, {half}), 'm', slice({sizes}, 1, {half}), 'r', slice({places}, {half} + 1, size({places})), 'n', slice({sizes}, {half} + 1, size({sizes})))"

    def moved(h: str) -> str:
        by = f"cast(conv(substring({h}, ({i} % 16) * 4 + 1, 4), 16, 10) as int)"
        return f"transform({s}.l, ({x}, {i}) -> cast(({x} + {by}) % {s}.m[{i}] as int))"

    keyed = f"sha2(concat_ws('|', {secret}, {tweak}, cast({r} as string), array_join(cast({s}.r as array<string>), ',')), 256)"
    step = f"named_struct('l', {s}.r, 'm', {s}.n, 'r', {_let(keyed, moved)}, 'n', {s}.m)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, ({s}, {r}) -> {step}, {s} -> concat({s}.l, {s}.r))"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Check digit that follows ``digits``."""
    c, i, s, x = (_name() for _ in range(4))
    doubled = f"(int({c}) * 2) % 10 + int({c}) div 5"
    values = f"transform(split({digits}, ''), ({c}, {i}) -> cast(if((length({digits}) - {i}) % 2 = 1, {doubled}, int({c})) as bigint))"
    return f"pmod(-aggregate({values}, 0L, ({s}, {x}) -> {s} + {x}), 10)"


def _mod97(chars: str) -> str:
    """Remainder by 97 of a bank number's characters, letters counting 10 to 35."""
    s, c = _name(), _name()
    step = f"if({c} between '0' and '9', {s} * 10 + int({c}), {s} * 100 + ascii({c}) - 55) % 97"
    return f"aggregate(split({chars}, ''), 0, ({s}, {c}) -> cast({step} as int))"


def _day(value: str, kind: str) -> str:
    """Day of the cycle, from 0, that a date of kind iso, day (day first) or month (month first) names; else null."""
    parts = ((7, 4, 1), (7, 1, 4))
    by = [f"concat(substring({value}, {y}), '-', substring({value}, {m}, 2), '-', substring({value}, {d}, 2))" for y, m, d in parts]
    day = f"datediff(try_to_date({_case(kind, {'iso': value, 'day': by[0]}, by[1])}, 'yyyy-MM-dd'), date'{FIRST_DAY}')"
    x = _name()
    return f"get(filter(array({day}), {x} -> {x} between 0 and {DAY_HALVES[0] * DAY_HALVES[1] - 1}), 0)"


def _holds(value: str, kind: str) -> str:
    """Whether a value of a kind is valid: check digits, ranges, dates of the calendar."""
    luhn = _let(_digits(value), lambda d: f"(length({d}) > 1 and int(right({d}, 1)) = {_luhn(f'substring({d}, 1, length({d}) - 1)')})")
    iban = _let(f"replace({value}, ' ', '')", lambda v: f"({_mod97(f'concat(substring({v}, 5), substring({v}, 1, 4))')} = 1)")
    tests = {"number": luhn, "iban": iban, "tax": f"{value} rlike '{TAX_ID}'", "tax9": f"{value} rlike '{TAX_ID_9}'"}
    return _case(kind, tests | {"iso day month": f"{_day(value, kind)} is not null"}, "true")


def found(value: str) -> str:
    """The valid values in a match of ANY: an array of ``at, size, kind``, in order.

    A run is a number as a whole if it has 13 to 19 digits and its Luhn digit holds. Else it is read
    from group to group: where groups are a date, a phone, a tax id or a valid number in GROUPS, they
    are a value; other groups stay.
    """
    s, g, c = (_name() for _ in range(3))
    as_ = lambda text, *kinds: [f"named_struct('text', {text}, 'kind', {_quoted(k)})" for k in kinds]
    at_start = lambda head, x: f"regexp_extract({head}, '^(?:{x})(?![A-Za-z0-9])', 0)"
    whole = f"if({s}.at = 1 and {value} rlike '^(?:{FORMATS['number']})$', {value}, '')"

    def in_run(head: str) -> str:
        more = [*as_(whole, "number"), *as_(at_start(head, FORMATS["iso_date"]), "iso"), *as_(at_start(head, FORMATS["day_date"]), "day", "month")]
        more += [*as_(at_start(head, FORMATS["phone"]), "phone"), *as_(at_start(head, FORMATS["tax_id"]), "tax", "tax9")]
        return f"array({', '.join([*more, *(as_(at_start(head, x), 'number')[0] for x in GROUPS)])})"

    def read(kind: str) -> str:
        single = f"transform({_case(kind, {'day': "array('day', 'month')", 'tax': "array('tax', 'tax9')"}, f'array({kind})')}, {c} -> named_struct('text', {value}, 'kind', {c}))"
        choices = f"if({kind} = 'run', {_let(f'substring({value}, {s}.at, {WINDOW})', in_run)}, {single})"
        first = f"get(filter({choices}, {c} -> {c}.text <> '' and {_holds(f'{c}.text', f'{c}.kind')}), 0)"
        after = f"int({s}.at + length({g}) + 1)"
        skip = f"named_struct('at', {after}, 'next', {s}.next, 'out', {s}.out)"
        take = lambda f: f"if({f} is null, {skip}, named_struct('at', {after}, 'next', int({s}.at + length({f}.text)), 'out', concat({s}.out, array(named_struct('at', {s}.at, 'size', length({f}.text), 'kind', {f}.kind)))))"
        step = f"if({s}.at < {s}.next, {skip}, {_let(first, take)})"
        groups = f"if({kind} = 'run', split({value}, '[ -]', -1), array({value}))"
        zero = "named_struct('at', 1, 'next', 1, 'out', cast(array() as array<struct<at: int, size: int, kind: string>>))"
        return f"aggregate({groups}, {zero}, ({s}, {g}) -> {step}, {s} -> {s}.out)"

    tests = " ".join(f"when {value} rlike {_quoted(x)} then {_quoted(k)}" for k, x in KINDS.items())
    return _let(f"case {tests} else 'run' end", read)


def pseudonym(value: str, kind: str, secret: str = "secret") -> str:
    """The pseudonym of a valid value of a kind."""
    ten = f"right({_digits(value)}, 10)"
    bodies = {
        "email": f"lower(regexp_replace({value}, '{LAST_LABEL}', ''))",
        "key": f"substring({value}, 5)",
        "hex": value,
        "phone": f"concat(substring({ten}, 2, 2), substring({ten}, 5, 6))",
        "number": _let(_digits(value), lambda d: f"substring({d}, 1, length({d}) - 1)"),
        "iban": f"substring(replace({value}, ' ', ''), 5)",
    }
    a, b = DAY_HALVES
    groups = f"array({', '.join(map(str, TAX_GROUPS))})"
    area, group, serial = (f"int(substring({value}, {at}, {n}))" for at, n in ((1, 3), (5, 2), (8, 4)))
    c, d, i = (_name() for _ in range(3))
    dates = "iso day month"

    def made(body: str) -> str:
        letters = f"if({kind} = 'hex', 6, 26)"
        kinds = lambda digit, small, large, other: f"case when {c} between '0' and '9' then {digit} when {c} between 'a' and 'z' then {small} when {c} between 'A' and 'Z' then {large} else {other} end"
        chars = f"split({body}, '')"
        places = {
            "address": f"transform(split({value}, '[.]'), {c} -> int({c}))",
            dates: _let(_day(value, kind), lambda x: f"array(int({x} div {b}), int({x} % {b}))"),
            "tax": f"array({area} - if({area} > 666, 2, 1), {group} - 1, {serial} - 1)",
            "tax9": f"array({area} - 900, int(array_position({groups}, {group})) - 1, {serial})",
        }
        sizes = {"address": "array(256, 256, 256, 256)", dates: f"array({a}, {b})", "tax": "array(898, 99, 9999)", "tax9": f"array(100, {len(TAX_GROUPS)}, 10000)"}
        own = _case(kind, places, f"transform({chars}, {c} -> {kinds(f'ascii({c}) - 48', f'ascii({c}) - 97', f'ascii({c}) - 65', '0')})")
        own_sizes = _case(kind, sizes, f"transform({chars}, {c} -> {kinds('10', letters, letters, '1')})")
        tweak = _case(kind, {"iso day": "'day'"}, kind)
        day = lambda x: f"date_add(date'{FIRST_DAY}', {x}[0] * {b} + {x}[1])"

        def through(pair: str) -> str:
            # A month-first date is permuted again until it is not a day-first one, so both kinds stay apart.
            again = f"if({i} = 0 or dayofmonth({day(d)}) <= 12, {permuted(d, f'{pair}.sizes', tweak, secret)}, {d})"
            return f"aggregate(sequence(0, if({kind} = 'month', 256, 0)), {pair}.places, ({d}, {i}) -> {again})"

        def put(new: str) -> str:
            part = lambda number, n: f"lpad(cast({number} as string), {n}, '0')"
            tax = [f"({new}[0] + if({new}[0] >= 665, 2, 1))", f"({new}[1] + 1)", f"({new}[2] + 1)"]
            tax9 = [f"({new}[0] + 900)", f"{groups}[{new}[1]]", f"{new}[2]"]
            joined = lambda parts: f"concat_ws('-', {', '.join(part(x, n) for x, n in zip(parts, (3, 2, 4), strict=True))})"
            sep = f"substring({value}, 3, 1)"
            form = lambda *x: f"concat({f', {sep}, '.join(f'date_format({day(new)}, {_quoted(y)})' for y in x)})"
            text = f"array_join(zip_with({chars}, {new}, ({c}, {d}) -> {kinds(f'char(48 + {d})', f'char(97 + {d})', f'char(65 + {d})', c)}), '')"

            def of_text(t: str) -> str:
                country = f"substring({value}, 1, 2)"
                check = f"lpad(cast(98 - {_mod97(f'concat({t}, {country}, {_quoted("00")})')} as string), 2, '0')"
                fill = {
                    "phone": f"concat({_let(_digits(value), lambda x: f'substring({x}, 1, length({x}) - 9)')}, substring({t}, 1, 2), substring({ten}, 4, 1), substring({t}, 3))",
                    "number": f"concat({t}, {_luhn(t)})",
                    "iban": f"concat({country}, {check}, {t})",
                }
                x = _name()
                refilled = _let(_case(kind, fill, "''"), lambda f: f"array_join(transform(split({value}, if({kind} = 'iban', '[A-Z0-9]', '[0-9]'), -1), ({x}, {i}) -> concat({x}, substring({f}, {i} + 1, 1))), '')")
                cased = f"array_join(zip_with(split({t}, ''), split(left({value}, length({t})), ''), ({x}, {c}) -> if({c} between 'A' and 'Z', upper({x}), {x})), '')"
                return _case(kind, {"email": f"concat({cased}, regexp_extract({value}, '{LAST_LABEL}', 0))", "key": f"concat(left({value}, 4), {t})", "hex": t}, refilled)

            forms = {
                "address": f"array_join(cast({new} as array<string>), '.')", "iso": f"date_format({day(new)}, 'yyyy-MM-dd')",
                "day": form("dd", "MM", "yyyy"), "month": form("MM", "dd", "yyyy"), "tax": joined(tax), "tax9": joined(tax9),
            }
            return _case(kind, forms, _let(text, of_text))

        return _let(_let(f"named_struct('places', {own}, 'sizes', {own_sizes})", through), put)

    return _let(_case(kind, bodies, "''"), made)


def replaced(value: str, values: str, secret: str = "secret") -> str:
    """A match of ANY with the values that ``found`` names replaced."""
    f, i = _name(), _name()
    start = f"coalesce(get({values}, {i} - 1).at + get({values}, {i} - 1).size, 1)"
    new = _let(f"substring({value}, {f}.at, {f}.size)", lambda v: pseudonym(v, f"{f}.kind", secret))
    parts = f"transform({values}, ({f}, {i}) -> concat(substring({value}, {start}, {f}.at - {start}), {new}))"
    rest = f"substring({value}, coalesce(get({values}, size({values}) - 1).at + get({values}, size({values}) - 1).size, 1))"
    return f"concat(array_join({parts}, ''), {rest})"


def secret_table(spark: SparkSession, key: str) -> DataFrame:
    """A one-row table for a secret that is at hand as text; a deployment reads one from its store."""
    return spark.createDataFrame([(key,)], "secret string")


def pseudonymised(docs: DataFrame, key: str | DataFrame, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the values of FORMATS in ``text`` replaced by their pseudonyms.

    ``key`` is the secret, as text or as a table of one row and one column; ``count`` names a column
    for the number of valid values found, those replaced. A text without
    values, an empty one and a null one stay as they are; strings that look like a date but are
    none, or lie outside 1800 to 2199, stay too and are not counted. Other columns stay, whatever their names.
    """
    secrets = secret_table(docs.sparkSession, key) if isinstance(key, str) else key
    rows, body = renamed(docs, text)
    old = F.coalesce(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    out = rows.withColumn("old", old).withColumn("values", F.expr(f"transform(old, value -> {found('value')})"))
    some = F.exists("values", lambda x: F.size(x) > 0)
    out = out.withColumn("some", some).withColumn("secret", F.when(F.col("some"), secrets.toDF("secret").scalar()))
    out = out.withColumn("new", F.expr(f"if(some, zip_with(old, values, (value, places) -> {replaced('value', 'places')}), null)"))
    between = F.split(body, ANY, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("new", i), F.lit("")))), "")
    out = out.withColumn(body, F.when(F.col("some"), joined).otherwise(F.col(body)))
    if not count:
        return restored(out, docs)
    total = F.aggregate("values", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("total")
    return out.select(*rows.columns, total).toDF(*docs.columns, count)


def pseudonymise_documents(docs: DataFrame, key: str | DataFrame) -> DataFrame:
    """Documents with pseudonyms for personal values; ``n_chars`` follows the new text where there is one."""
    out = pseudonymised(docs, key)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", length)
    return out
