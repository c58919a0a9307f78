"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
_IP = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![0-9A-Za-z]|[./-]\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-\d)"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_CARD = r"\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])"
_NATIONAL = r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9A-Za-z]|[.-]\d)"
_PHONE = r"\+\d(?:[ ./()-]{0,2}\d){7,14}(?![0-9A-Za-z])"
#: what may be a value; whether it is one is validated afterwards
FOUND = rf"(?<![0-9A-Za-z])(?:{_EMAIL}|{_IBAN}|{_IP}|{_DATE}|{_SSN}|{_CARD}|{_NATIONAL})|(?<![0-9A-Za-z+])(?:{_PHONE})"
_WHOLE = rf"^(?:{_EMAIL}|{_IBAN}|{_IP}|{_DATE}|{_SSN}|{_CARD}|{_NATIONAL}|{_PHONE})$"
_CLOSED = r"(?![0-9A-Za-z]|[0-9A-Za-z._%+-]{0,64}@)"
#: where values may lie side by side: runs of digits (after an IBAN's head also of capitals) and separators that do not reach into an
#: address. Character classes only: the engine recurses over repeated groups
REGION = rf"(?<![0-9A-Za-z])(?:{_EMAIL}|[A-Z]{{2}}\d{{2}}[0-9A-Z ./()+-]{{8,}}[0-9A-Z]{_CLOSED}|(?!(?<=\d\.)\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d))[+(]?\d[0-9 ./()+-]{{5,}}\d{_CLOSED})"
#: the candidates of every length at one place
_IBANS = [rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{k}}}{tail}(?![0-9A-Za-z])" for k in range(2, 8) for tail in ("", " ?[A-Z0-9]{1,3}")]
_CARDS = [rf"\d(?:[ -]?\d){{{n - 1}}}(?![0-9A-Za-z])" for n in range(13, 20)]
_PHONES = [rf"\+\d(?:[ ./()-]{{0,2}}\d){{{n - 1}}}(?![0-9A-Za-z])" for n in range(8, 16)]
#: candidates that go before card numbers in odd groups and before other countries' phone numbers, of which many lengths validate
_USUAL = (
    rf"^(?:[A-Z].*|{_IP}|{_DATE}|{_SSN}|{_NATIONAL}|\+1(?:[ ./()-]{{0,2}}\d){{10}}"
    r"|\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})$"
)


def _digest(key: str, tag: str, step: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), step.cast("string"), value.cast("string")), 256)


def permuted(x: Column, a: int, b: int, key: str, tag: str) -> Column:
    """Keyed permutation of 0 .. a * b - 1: an unbalanced Feistel network over (x div b, x mod b)."""

    def number(step: Column, value: Column) -> Column:
        return F.conv(F.substring(_digest(key, tag, step, value), 1, 15), 16, 10).cast("long")

    def turn(s: Column, step: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + F.pmod(number(step, s["r"]), F.lit(a)), F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(number(step, s["l"]), F.lit(b)), F.lit(b)).cast("long").alias("r"))
        return F.when(step % 2 == 0, left).otherwise(right)

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r")) if b < 2**26 else None
    start = start if start is not None else F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted_text(text: Column, key: str, tag: str) -> Column:
    """Keyed permutation of the strings of one pattern: letters stay letters of their case, digits digits, all else itself.

    A Feistel network over the first and second half; a round adds the other half's digest, character by character.
    """

    def shifted(half: Column, other: Column, step: Column) -> Column:
        digest = _digest(key, tag, step, other)

        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(digest, F.pmod(i, F.lit(31)) * 2 + 1, F.lit(3)), 16, 10).cast("int")
            code = F.ascii(c)

            def within(first: int, n: int) -> Column:
                return F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))

            return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

        chars = F.filter(F.split(half, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, one), "")

    def turn(s: Column, step: Column) -> Column:
        left = F.struct(shifted(s["l"], s["r"], step).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], step).alias("r"))
        return F.when(step % 2 == 0, left).otherwise(right)

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        isd = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(isd, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + isd.cast("int")).alias("at"))

    return F.aggregate(chars, start, put, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits that lack or have their check digit in the last place (weight 1)."""
    n = F.length(digits)
    chars = F.filter(F.split(digits, ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(chars, value), F.lit(0), lambda s, d: s + d)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN, its first four characters moved to the end and letters read as 10 .. 35."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(s * 100 + code - 55, F.lit(97))).otherwise(F.pmod(s * 10 + code - 48, F.lit(97))).cast("int")

    return F.aggregate(chars, F.lit(0), add)


def _pad(x: Column, n: int | Column) -> Column:
    return F.lpad(x.cast("string"), n, "0") if isinstance(n, int) else F.substr(F.concat(F.repeat(F.lit("0"), F.lit(20)), x.cast("string")), F.length(x.cast("string")) + 21 - n)


def _by_length(digits: Column, lengths: range, key: str, tag: str) -> Column:
    """Permute a digit string within its length."""
    out = F.lit(None).cast("string")
    for n in lengths:
        out = F.when(F.length(digits) == n, _pad(permuted(digits.cast("long"), 10 ** (n - n // 2), 10 ** (n // 2), key, f"{tag} {n}"), n)).otherwise(out)
    return out


def _card(hit: Column, key: str) -> Column:
    d = _digits(hit)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _by_length(F.substr(d, F.lit(2), F.length(d) - 2), range(11, 18), key, "card"))
    # the permuted body with its check digit; equal numbers agree however they are spaced
    check = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.when(F.pmod(_luhn(d), F.lit(10)) == 0, _laid_out(hit, check))


def _ip(hit: Column, key: str) -> Column:
    part = F.transform(F.split(hit, r"\."), lambda p: p.cast("long"))
    x = ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]
    new = F.transform(F.array(permuted(x, 65536, 65536, key, "ip")), lambda y: F.concat_ws(".", *(F.pmod(F.shiftright(y, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))[0]
    return F.when(~F.exists(part, lambda p: p > 255), new)


def _ssn(hit: Column, key: str) -> Column:
    d = F.split(hit, "-")
    area, group, serial = (d[i].cast("long") for i in range(3))
    x = (area - 1 - (area > 666).cast("long")) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    y = permuted(x, 898, 99 * 9999, key, "ssn")

    def text(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("long") + 1
        return F.concat_ws("-", _pad(a + (a > 665).cast("long"), 3), _pad(F.pmod(F.floor(v / 9999).cast("long"), F.lit(99)) + 1, 2), _pad(F.pmod(v, F.lit(9999)) + 1, 4))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.transform(F.array(y), text)[0])


def _date(hit: Column, key: str) -> Column:
    """A date of 1900 .. 2099 becomes another of its century, in the same notation."""
    out = F.lit(None).cast("string")
    for form, pattern in (("dd/MM/yyyy", r"^\d\d/"), ("MM/dd/yyyy", r"^\d\d/"), ("dd.MM.yyyy", r"^\d\d\."), ("yyyy-MM-dd", r"^\d{4}-")):
        day = F.try_to_timestamp(hit, F.lit(form)).cast("date")
        # days of a century: 36524 = 92 * 397 and 36525 = 75 * 487
        for first, year, a, b in (("1900-01-01", 1900, 92, 397), ("2000-01-01", 2000, 75, 487)):
            x = F.datediff(day, F.lit(first).cast("date")).cast("long")
            new = F.date_format(F.date_add(F.lit(first).cast("date"), permuted(x, a, b, key, f"date {year}").cast("int")), form)
            out = F.when(hit.rlike(pattern) & F.year(day).between(year, year + 99), new).otherwise(out)
    return out


def _iban(hit: Column, key: str) -> Column:
    d = F.regexp_replace(hit, " ", "")
    body = F.concat(F.substr(d, F.lit(1), F.lit(2)), F.lit("00"), permuted_text(F.substr(d, F.lit(5)), key, "iban"))
    new = F.transform(F.array(body), lambda b: F.concat(F.substr(b, F.lit(1), F.lit(2)), _pad(98 - _mod97(b), 2), F.substr(b, F.lit(5))))[0]
    spaced = F.when(hit.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return F.when((_mod97(d) == 1) & F.length(d).between(15, 34), spaced)


def _phone(hit: Column, key: str) -> Column:
    """North American numbers keep their country code; dialable ones stay so. Of others the country's first two digits stay."""
    d = _digits(hit)
    ten = F.when(hit.startswith("+"), F.substr(d, F.lit(2))).otherwise(d)
    area, office, line = (F.substr(ten, F.lit(p), F.lit(n)).cast("long") for p, n in ((1, 3), (4, 3), (7, 4)))
    y = permuted(((area - 200) * 800 + office - 200) * 10_000 + line, 80_000, 80_000, key, "phone")

    def text(v: Column) -> Column:
        area, office = F.floor(v / 8_000_000).cast("long") + 200, F.pmod(F.floor(v / 10_000).cast("long"), F.lit(800)) + 200
        return F.concat(area.cast("string"), office.cast("string"), _pad(F.pmod(v, F.lit(10_000)), 4))

    american = (~hit.startswith("+") | hit.startswith("+1")) & (F.length(ten) == 10) & (area >= 200) & (office >= 200)
    # the other 3.6e9 numbers of ten digits are permuted among themselves
    low = F.when(area < 200, ten.cast("long")).otherwise(((area - 200) * 200 + office) * 10_000 + line + 2_000_000_000)

    def low_text(v: Column) -> Column:
        w = v - 2_000_000_000
        high = F.concat((F.floor(w / 2_000_000).cast("long") + 200).cast("string"), _pad(F.pmod(F.floor(w / 10_000).cast("long"), F.lit(200)), 3), _pad(F.pmod(w, F.lit(10_000)), 4))
        return F.when(w < 0, _pad(v, 10)).otherwise(high)

    undialled = F.transform(F.array(permuted(low, 60_000, 60_000, key, "phone below 200")), lambda v: _laid_out(hit, F.concat(F.lit("1"), low_text(v))))[0]
    home = F.transform(F.array(y), lambda v: _laid_out(hit, F.concat(F.when(hit.startswith("+"), "1").otherwise(""), text(v))))[0]
    rest = _by_length(F.substr(d, F.lit(3)), range(6, 14), key, "abroad")
    abroad = F.when(hit.startswith("+") & ~hit.startswith("+1"), _laid_out(hit, F.concat(F.substr(d, F.lit(1), F.lit(2)), rest)))
    return F.when(american, home).when(hit.startswith("+1") & (F.length(ten) == 10), undialled).otherwise(abroad)


def _email(hit: Column, key: str) -> Column:
    """The local part is permuted within its pattern (case does not link apart); the domain stays."""
    local = F.lower(F.substring_index(hit, "@", 1))
    return F.concat(permuted_text(local, key, "email"), F.lit("@"), F.substring_index(hit, "@", -1))


#: kind, its whole pattern, its pseudonym (NULL where the value is not valid); the first pattern that fits decides
KINDS: tuple[tuple[str, str, Callable[[Column, str], Column]], ...] = (
    ("email", "@", _email),
    ("iban", r"^[A-Z]{2}\d{2}", _iban),
    ("ip", r"^\d{1,3}(\.\d{1,3}){3}$", _ip),
    ("date", r"^(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$", _date),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", _ssn),
    ("phone", r"^(\+|\(|\d{3}[ .-]\d{3}[ .-]\d{4}$)", _phone),
    ("card", r"^\d", _card),
)


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of a value, NULL if it is not valid."""
    out = F.lit(None).cast("string")
    for _, pattern, new in reversed(KINDS):
        out = F.when(hit.rlike(pattern), new(hit, key)).otherwise(out)
    return out


def _candidates(region: Column) -> Column:
    """(rank, start, -length, text) of what may be a value in a region: the whole, usual formats, other formats."""

    def at(i: Column, here: Column) -> Column:
        found = [F.regexp_extract(here, f"^(?:{p})", 0) for p in (*_IBANS, _DATE, _SSN, *_CARDS, _NATIONAL, *_PHONES)]
        found.append(F.when((i > 2) & F.substr(region, i - 2, F.lit(2)).rlike(r"^\d\.$"), F.lit("")).otherwise(F.regexp_extract(here, f"^(?:{_IP})", 0)))
        each = F.filter(F.array_distinct(F.array(*found)), lambda t: t != "")
        return F.transform(each, lambda t: F.struct(F.when(t.rlike(_USUAL), 0).otherwise(1).alias("rank"), i.alias("start"), (-F.length(t)).alias("length"), t.alias("text")))

    def begins(i: Column) -> Column:
        return F.substr(region, i, F.lit(1)).rlike("[0-9A-Z+(]") & ((i == 1) | ~F.substr(region, i - 1, F.lit(1)).rlike("[0-9A-Za-z]"))

    starts = F.filter(F.sequence(F.lit(1), F.length(region)), begins)
    parts = F.flatten(F.zip_with(starts, F.transform(starts, lambda i: F.substr(region, i, F.lit(64))), at))
    whole = F.array(F.struct(F.lit(-1).alias("rank"), F.lit(1).alias("start"), (-F.length(region)).alias("length"), region.alias("text")))
    parts = F.when(region.contains("@"), F.slice(parts, 1, 0)).otherwise(parts)
    return F.when(region.rlike(_WHOLE), F.concat(whole, parts)).when(region.rlike(FOUND), parts).otherwise(F.slice(whole, 1, 0))


def _take(taken: Column, c: Column) -> Column:
    apart = F.forall(taken, lambda t: (t["start"] - t["length"] <= c["start"]) | (c["start"] - c["length"] <= t["start"]))
    return F.when(apart, F.concat(taken, F.array(c))).otherwise(taken)


def _put_in(region: Column, taken: Column) -> Column:
    """``region`` with the taken values' pseudonyms in their places."""

    def put(s: Column, t: Column) -> Column:
        return F.struct(F.concat(s["out"], F.substr(region, s["at"], t["start"] - s["at"]), t["new"]).alias("out"), (t["start"] - t["length"]).alias("at"))

    order = F.array_sort(F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["new"].alias("new"))))
    return F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: F.concat(s["out"], F.substr(region, s["at"])))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal numbers, dates and addresses in ``docs`` by pseudonyms; adds ``n_replaced``.

    A value is replaced when it validates: card numbers by Luhn, IBANs by mod 97, IPv4 octets, US social
    security ranges, calendar dates of 1900 to 2099, North American and ``+`` phone numbers, e-mail
    addresses. Where numbers lie side by side, every part between borders of groups is tried, so that a
    value is also found beside others. A keyed Feistel permutation maps it to a valid value of the same format and notation, so
    the same value becomes the same pseudonym in every document, and different values of a format stay
    different. A slash date is month first if that is a date, else day first. All is done in the row,
    with built-in functions; there is no shuffle. All columns of ``docs`` are kept (one named
    ``n_replaced`` is overwritten).

    NULL text stays NULL and has n_replaced 0; a text without values stays as it is.
    """
    names = [c for c in docs.columns if c != "n_replaced"]
    keep, regions, new = [F.col(f"`{c}`") for c in names], "__regions", "__new"

    def renewed(c: Column) -> Column:
        return F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["length"].alias("length"), pseudonym(c["text"], key).alias("new"))

    out = docs.select(*keep, F.regexp_extract_all(F.col(text), F.lit(REGION), F.lit(0)).alias(regions))
    out = out.select(*keep, regions, F.transform(F.col(regions), _candidates).alias(new))
    out = out.select(*keep, regions, F.transform(F.col(new), lambda cs: F.array_sort(F.filter(F.transform(cs, renewed), lambda c: c["new"].isNotNull()))).alias(new))
    out = out.select(*keep, regions, F.transform(F.col(new), lambda cs: F.aggregate(cs, F.slice(cs, 1, 0), _take)).alias(new))
    parts = F.zip_with(F.split(F.col(text), REGION, -1), F.zip_with(F.col(regions), F.col(new), _put_in), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    replaced = F.when(F.size(regions) > 0, F.array_join(parts, "")).otherwise(F.col(text))
    count = F.when(F.size(regions) > 0, F.aggregate(F.col(new), F.lit(0), lambda s, n: s + F.size(n))).otherwise(0)
    return out.select(*(replaced.alias(c) if c == text else F.col(f"`{c}`") for c in names), count.cast("int").alias("n_replaced"))
