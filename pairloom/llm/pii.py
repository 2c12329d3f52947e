"""Format-preserving Feistel pseudonyms for personal data in texts, in DataFrame functions only.

One pattern finds candidates in the whole text; each is validated (card numbers by their check digit, addresses by their
octets, dates by the calendar, social security numbers by their areas) and replaced by a keyed permutation of the values of its format:

* cards keep their length, separators and a valid check digit; they are looked for in whole runs of digit groups, at the edges of groups,
  so a short number before or after one (expiry, code, row number) neither hides nor changes it; phones keep their separators and country prefix;
* e-mail addresses keep their domain, the marks of the local part, and digits and the letters of each alphabet in ALPHABETS stay such (letters are
  lower-cased, those of other alphabets stay as they are);
* IPv4 addresses are permuted among all addresses; those with leading zeros among those whose octets have the same widths and leading zeros;
* dates of 1900-2099 are permuted among these days, in all notations alike; month-first ones that can't be read day-first among such;
  social security numbers of valid areas among such.

A permutation depends on the key and the format alone, so equal values have equal pseudonyms in all documents and different values of a format
different ones. Permutations are Feistel networks over strings (digits added modulo the alphabet) or over a product of two residue rings. Who has the
key can invert them, so the key has no default.

Null texts stay null, empty ones empty, texts without candidates as they are; very long texts are read whole, in time in proportion; a null doc_id stays
null; repeated rows repeat; all other columns pass through `pseudonymise` untouched, whatever their names. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the local part beyond a-z: Latin-1, Latin Extended-A, Greek and Cyrillic, as ranges of lower-case letters; each range is permuted in itself.
ALPHABETS = [[chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))], [chr(c) for c in range(0x101, 0x180) if chr(c).islower() and len(chr(c).upper()) == 1], [chr(c) for c in range(0x3B1, 0x3CA)], [chr(c) for c in range(0x430, 0x460)]]
ALPHABETS = ["".join(x) for x in ALPHABETS]

#: Candidates. Possessive runs and look-behinds keep the search linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u1FFF\u2C00-\u2DFF\u3040-\uD7FF-])[A-Za-z0-9._%+\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u1FFF\u2C00-\u2DFF\u3040-\uD7FF-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dmy": r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What may stand after a card and isn't part of its run of digit groups: after either separator, and after a space only.
_APART = PATTERNS["dmy"], PATTERNS["ip"]
_SPACED = *_APART, PATTERNS["iso"], PATTERNS["ssn"], PATTERNS["phone"], r"[A-Za-z0-9._%+\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u1FFF\u2C00-\u2DFF\u3040-\uD7FF-]++@[A-Za-z0-9-]++\."
PATTERNS["card"] = rf"(?<![0-9])(?=[0-9](?:[ -]?+[0-9]){{12}})[0-9]++(?:(?: (?!{'|'.join(_SPACED)})|-(?!{'|'.join(_APART)}))[0-9]++)*+"
#: All but addresses begin with a digit, + or (: one look there spares other places the trial of each pattern. Texts without @ need no more than these.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join(p for kind, p in PATTERNS.items() if kind != 'email')})"
ANY = f"{PATTERNS['email']}|{NUMBERS}"

#: 73,049 days from 1900-01-01 to 2099-12-31, 898 areas (001-899 without 666) by 99 groups by 9,999 serials.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
AREAS, REST = 898, 99 * 9999

#: Cards as they are grouped, surest first: usual groupings by the first digit, then groups of three digits and more.
GROUPINGS = [r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})"]
GROUPINGS = [f"^(?=[2-6]){GROUPINGS[0]}$", f"^{GROUPINGS[0]}$", "^[0-9]{3,}(?:[ -][0-9]{3,})*$"]


def _bind(x: Column, f) -> Column:
    """f of x, which is computed once; what a lambda names without it is computed again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _stream(key: str, tweak: str | Column, i: Column, other: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other), bits)


def _shift(x: Column, hex_: Column, alphabet: str) -> Column:
    letters = F.lit(alphabet)

    def shifted(h: Column) -> Column:
        def one(j: Column) -> Column:
            step = F.conv(F.substring(h, 2 * ((j - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
            return F.substring(letters, (F.instr(letters, F.substring(x, j, F.lit(1))) - 1 + step) % len(alphabet) + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")

    return F.when(F.length(x) == 0, x).otherwise(_bind(hex_, shifted))


def permute_string(s: Column, alphabet: str, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings over the alphabet that have the length of s."""
    half = (F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def turn(state: Column, i: Column) -> Column:
        size = F.concat(F.length(state["l"]).cast("string"), F.lit(","), F.length(state["r"]).cast("string"), F.lit(","))
        left = _shift(state["l"], _stream(key, tweak, i, F.concat(size, state["r"]), 512), alphabet)
        right = _shift(state["r"], _stream(key, tweak, i, F.concat(size, state["l"]), 512), alphabet)
        return F.when(i % 2 == 0, F.struct(left.alias("l"), state["r"].alias("r"))).otherwise(F.struct(state["l"].alias("l"), right.alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["l"], x["r"]))


def permute_number(x: Column, a: int | Column, b: int | Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def turn(state: Column, i: Column) -> Column:
        def draw(other: str) -> Column:
            return F.conv(F.substring(_stream(key, tweak, i, state[other].cast("string"), 256), 1, 13), 16, 10).cast("long")

        left = F.struct(((state["l"] + draw("r")) % a).alias("l"), state["r"].alias("r"))
        return F.when(i % 2 == 0, left).otherwise(F.struct(state["l"].alias("l"), ((state["r"] + draw("l")) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _put_back(template: Column, chars: Column, kind: str) -> Column:
    """The template with its characters of the class replaced by chars, in order."""

    def placed(new: Column) -> Column:
        def one(p: Column) -> Column:
            c = F.substring(template, p, F.lit(1))
            nth = F.length(F.regexp_replace(F.substring(template, F.lit(1), p), f"[^{kind}]", ""))
            return F.when(c.rlike(f"[{kind}]"), F.substring(new, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), one), "")

    return F.when(F.length(template) == 0, template).otherwise(_bind(chars, placed))


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """The weighted digit sum; from the right, each second digit counts double, beginning with the first if doubled_from is 0."""

    def summed(back: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(back, i, F.lit(1)).cast("int")
            return total + F.when((i - 1) % 2 == doubled_from, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return _bind(F.reverse(digits), summed)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_string(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, "card")
    whole = _bind(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
    return _put_back(m, whole, "0-9")


def _cards_at(groups: Column) -> Column:
    """For each of the groups (digits and the mark after them) the surest card that begins there, as (level, minus its groups), or null.

    Of equal levels the longest comes first. Other groupings than those listed are cards only where they begin or end the run.
    """

    def here(i: Column) -> Column:
        def one(k: Column) -> Column:
            def judged(part: Column) -> Column:
                level = F.lit(None).cast("int")
                level = F.when((i == 0) | (i + k == F.size(groups)), len(GROUPINGS)).otherwise(level)
                for n in reversed(range(len(GROUPINGS))):
                    level = F.when(part.rlike(GROUPINGS[n]), n).otherwise(level)
                digits = F.regexp_replace(part, "[^0-9]", "")
                good = F.length(digits).between(13, 19) & level.isNotNull()
                return F.when(good, F.when(luhn_sum(digits, 1) % 10 == 0, F.struct(level.alias("level"), (-k).alias("k"))))

            return _bind(F.regexp_replace(F.array_join(F.slice(groups, i + 1, k), ""), "[ -]$", ""), judged)

        return F.array_min(F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), one))

    return F.transform(F.sequence(F.lit(0), F.size(groups) - 1), here)


def _cards(m: Column, key: str) -> Column:
    """(the run of digit groups with each card in it replaced, the number of cards). A card gives way to a surer one that begins in it."""

    def chosen(at: Column) -> Column:
        def take(state: Column, i: Column) -> Column:
            own = F.get(at, i)
            surer = F.exists(F.slice(at, i + 2, -own["k"] - 1), lambda x: F.coalesce(x["level"] < own["level"], F.lit(False)))
            more = F.struct((i - own["k"]).alias("free"), F.array_append(state["spans"], F.struct(i.alias("i"), (-own["k"]).alias("k"))).alias("spans"))
            return F.when((i < state["free"]) | own.isNull() | surer, state).otherwise(more)

        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,k:int>>").alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, take, lambda s: s["spans"])

    def rebuilt(groups: Column, spans: Column) -> Column:
        text = lambda i, k: F.array_join(F.slice(groups, i + 1, k), "")
        end = lambda n: F.when(n == 0, 0).otherwise(F.get(spans, n - 1)["i"] + F.get(spans, n - 1)["k"])

        def part(x: Column, n: Column) -> Column:
            # the mark after a card is not one of its digits and stays where it is
            return F.concat(text(end(n), x["i"] - end(n)), _bind(text(x["i"], x["k"]), lambda c: _card(c, key)))

        last = end(F.size(spans))
        return F.concat(F.array_join(F.transform(spans, part), ""), text(last, F.size(groups) - last))

    run = lambda groups: _bind(chosen_of(groups), lambda spans: F.struct(F.when(F.size(spans) > 0, rebuilt(groups, spans)).otherwise(m).alias("b"), F.size(spans).alias("n")))
    chosen_of = lambda groups: _bind(_cards_at(groups), chosen)
    return _bind(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), run)


def _email(m: Column, key: str) -> Column:
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.substring_index(m, "@", -1)

    def changed(part: Column, alphabet: str, kind: str, tweak: str) -> Column:
        return _bind(part, lambda x: _put_back(x, permute_string(F.regexp_replace(x, f"[^{kind}]", ""), alphabet, key, tweak), kind))

    out = changed(changed(local, LETTERS, "a-z", "email"), DIGITS, "0-9", "email")
    for n, alphabet in enumerate(ALPHABETS):
        more = changed(out, alphabet, alphabet, f"email{n}")
        out = F.when(local.rlike(f"[{alphabet}]"), more).otherwise(out)
    return F.concat(out, F.lit("@"), domain)


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    new = permute_number(value, 65536, 65536, key, "ip")
    parts = F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda s: F.pmod(F.floor(new / F.pow(F.lit(2.0), s)), F.lit(256)).cast("long").cast("string"))
    odd = F.exists(octets, lambda x: x.rlike("^0[0-9]"))
    return F.when(F.exists(octets, lambda x: x.cast("int") > 255), m).when(odd, _bind(octets, lambda x: _padded_ip(x, key))).otherwise(F.array_join(parts, "."))


def _padded_ip(octets: Column, key: str) -> Column:
    """An address with leading zeros, permuted among those whose octets have the same widths and leading zeros."""
    o = [F.get(octets, i) for i in range(4)]
    zero, width = [x.rlike("^0[0-9]") for x in o], [F.length(x) for x in o]
    low = [F.when(z | (w == 1), 0).when(w == 2, 10).otherwise(100) for z, w in zip(zero, width)]
    n = [F.when(w == 3, F.when(z, 100).otherwise(156)).when((w == 2) & ~z, 90).otherwise(10).cast("long") for z, w in zip(zero, width)]
    at = [x.cast("long") - lo for x, lo in zip(o, low)]
    kind = F.concat(F.lit("ip"), *(F.concat(w.cast("string"), F.when(z, "z").otherwise("-")) for z, w in zip(zero, width)))
    new = permute_number((at[0] * n[1] + at[1]) * n[2] * n[3] + at[2] * n[3] + at[3], n[0] * n[1], n[2] * n[3], key, kind)

    def shown(x: Column) -> Column:
        head, tail = F.floor(x / (n[2] * n[3])), x % (n[2] * n[3])
        digit = [F.floor(head / n[1]), head % n[1], F.floor(tail / n[3]), tail % n[3]]
        return F.concat_ws(".", *(F.lpad((d + lo).cast("string"), w, F.lit("0")) for d, lo, w in zip(digit, low, width)))

    return _bind(new, shown)


def _day(m: Column, day: Column, key: str, pattern: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    at = F.datediff(day, first)
    new = F.date_add(first, permute_number(at.cast("long"), *DAYS, key, "day").cast("int"))
    return F.when(day.isNull() | (at < 0) | (at >= DAYS[0] * DAYS[1]), m).otherwise(F.date_format(new, pattern))


def _dmy(m: Column, key: str) -> Column:
    """Day first, or month first where only that is a date; the output keeps the order and the marks."""
    day = F.try_to_date(F.regexp_replace(m, "[./]", "-"), "dd-MM-yyyy")
    month = F.try_to_date(F.regexp_replace(m, "[./]", "-"), "MM-dd-yyyy")
    out = F.when(day.isNotNull(), _day(m, day, key, "dd-MM-yyyy")).otherwise(_month_first(m, month, key))
    return F.concat(F.substring(out, 1, 2), F.substring(m, 3, 1), F.substring(out, 4, 2), F.substring(m, 6, 1), F.substring(out, 7, 4))


def _month_first(m: Column, day: Column, key: str) -> Column:
    """Permuted until the day of the month is over 12 again, so it can't be read day-first. Each step ends it for 3 of 5 days."""
    first = F.lit(FIRST_DAY).cast("date")
    at = F.datediff(day, first).cast("long")
    date = lambda x: F.date_add(first, x.cast("int"))
    step = lambda s, _: F.when(s["done"], s).otherwise(_bind(permute_number(s["x"], *DAYS, key, "month"), lambda y: F.struct(y.alias("x"), (F.dayofmonth(date(y)) > 12).alias("done"))))
    new = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(at.alias("x"), F.lit(False).alias("done")), step, lambda s: s["x"])
    return F.when(day.isNull() | (at < 0) | (at >= DAYS[0] * DAYS[1]), m).otherwise(F.date_format(date(new), "MM-dd-yyyy"))


def _ssn(m: Column, key: str) -> Column:
    part = [F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4))]
    valid = (part[0] > 0) & (part[0] < 900) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0)
    area = part[0] - F.when(part[0] > 666, 2).otherwise(1)
    new = permute_number(area * REST + (part[1] - 1) * 9999 + part[2] - 1, AREAS, REST, key, "ssn")
    a = F.floor(new / REST) + F.when(F.floor(new / REST) >= 665, 2).otherwise(1)
    return F.when(valid, F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(new % REST / 9999) + 1).cast("string"), 2, "0"), F.lpad((new % 9999 + 1).cast("string"), 4, "0"))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    return F.concat(prefix, _bind(rest, lambda x: _put_back(x, permute_string(F.regexp_replace(x, "[^0-9]", ""), DIGITS, key, "phone"), "0-9")))


def pseudonym(m: Column, key: str) -> Column:
    """(b, n): the pseudonym of one candidate, or the candidate where it isn't valid, and the number of values replaced."""
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    one = lambda b: _bind(b, lambda x: F.struct(x.alias("b"), F.when(x != m, 1).otherwise(0).alias("n")))
    iso = F.try_to_date(m, "yyyy-MM-dd")
    return (
        F.when(F.contains(m, F.lit("@")), one(_email(m, key)))
        .when(full("ip"), one(_ip(m, key)))
        .when(full("iso"), one(_day(m, iso, key, "yyyy-MM-dd")))
        .when(full("dmy"), one(_dmy(m, key)))
        .when(full("ssn"), one(_ssn(m, key)))
        .when(full("phone"), one(_phone(m, key)))
        .otherwise(_cards(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """docs with the text column pseudonymised; with `counted`, one more column of that name: the number of values replaced (0 for null texts)."""
    t = F.col(f"`{text}`")
    if not key:
        raise ValueError("pseudonyms need a key")
    spare = {c.lower() for c in docs.columns}
    pairs = next(x for x in (f"_pairs{i}" for i in range(len(spare) + 1)) if x not in spare)
    mailed = F.contains(t, F.lit("@"))
    every = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    found = F.when(mailed, every(ANY)).when(t.rlike("[0-9]"), every(NUMBERS)).otherwise(F.array().cast("array<string>"))
    p = F.col(pairs)
    gaps = F.when(mailed, F.split(t, ANY, -1)).otherwise(F.split(t, NUMBERS, -1))
    joined = F.array_join(F.zip_with(gaps, p, lambda g, x: F.concat(g, F.coalesce(x["b"], F.lit("")))), "")
    out = docs.withColumn(pairs, F.transform(found, lambda m: pseudonym(m, key)))
    if counted:
        out = out.withColumn(counted, F.coalesce(F.aggregate(p, F.lit(0), lambda n, x: n + x["n"]), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.size(p) > 0, joined).otherwise(t)).drop(pairs)
