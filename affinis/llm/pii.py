"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts the score.

(operator 3, in DataFrame functions only)

Base kinds (score 1 once their check holds): email; ip with parts of at most 255; card with 12 to 19
digits that pass Luhn; phone with + and 9 to 15 digits. The method adds: iban (mod 97 leaves 1; as long as
its country's are, 15 to 34 for a country not listed) and key (an access key id by its fixed form); and
secret (a long value), ssn and local (a phone number without +) with a low score of their own, which count
only where a word of their kind within `WINDOW` code points before the span (for a secret: its name and = or
: just before it) lifts the score to `THRESHOLD`.
Spans of ssn and local that overlap a base span are dropped.

Matches come from regexp_extract_all and their places from the lengths of what split() leaves between
them, so places count code points and matches are leftmost and non-overlapping, as the regex finds them.
A pattern runs only over texts that hold a character or pair of characters it can't do without.

Patterns are possessive where what follows can't be matched by giving back, and email and ip start only where
a run of their first characters does (or where the last match ended): any later start in the run fares alike.
So matching is linear in the text, long runs included; places, masks and overlaps take sorts and folds over
blocks of BLOCK values. Defined results: null or empty text has no spans; repeated rows are
treated one by one; an empty table gives no rows; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import let

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Countries by the length of their IBANs; a match of a listed country ends there.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four, each after a space or none, to the country's length; 11 to 34 characters for codes not listed."""
    tail = lambda n: r"(?:\x20?[A-Z0-9]{4}){%d}" % (n // 4 - 1) + (r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
    listed = [f"(?:{'|'.join(c.split())})[0-9]{{2}}{tail(n)}" for n, c in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})" + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*listed, other])})(?![A-Za-z0-9])"


IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9-])"
KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12,}+"
NAMED = r"(?i)(?:token|password|passwd|secret|api[_-]?key)[\"']?\s*[=:]\s*[\"']?"
#: Kind, pattern, what a text must hold for a match, score of a confirmed match, words that lift it.
KINDS = [
    ("email", EMAIL, "@", 1.0, None),
    ("ip", IP, r"[0-9]\.[0-9]", 1.0, None),
    ("card", CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", 1.0, None),
    ("phone", PHONE, r"\+[0-9]", 1.0, None),
    ("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 1.0, None),
    ("key", KEY, "AKIA", 0.8, None),
    ("secret", SECRET, NAMED, 0.4, NAMED + "$"),
    ("ssn", SSN, r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"(?i)\b(?:ssn|social security|security no)"),
    ("local", LOCAL, r"[0-9)][\x20/-]?[0-9]{3}", 0.3, r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)"),
]
BASE = [k[0] for k in KINDS[:4]]
WINDOW, THRESHOLD, LIFT = 40, 0.7, 0.4
#: Code points of the shortest match of a kind with context words.
SHORTEST = 9
#: Values folded one by one; also the heads whose text is cut from one piece.
BLOCK = 256
SPAN = "struct<kind:string,rank:int,start:int,end:int,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(F.filter(at, lambda d: d != ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 once its first four characters are moved to its end."""
    moved = F.filter(F.split(F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(moved, value), F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return let(F.replace(m, F.lit(" "), F.lit("")), lambda b: F.when(F.length(b).between(15, 34), mod97(b)).otherwise(False))
    return F.lit(True)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over the values up to each place. An appended array is copied, so folds are over blocks and then over their ends."""
    fold = lambda v: F.aggregate(v, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(op(F.get(a, F.size(a) - 1), x), x)))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    joined = lambda parts, ends: F.flatten(F.transform(parts, lambda p, j: F.when(j == 0, p).otherwise(F.transform(p, lambda x: op(x, F.get(ends, j - 1))))))
    long = lambda v: let(blocks(v), lambda parts: let(fold(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), lambda ends: joined(parts, ends)))
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, fold(v)).otherwise(long(v)))


def _tail(text: Column) -> Column:
    return F.substring(text, -WINDOW, WINDOW)


def _placed(text: Column, kind: str, rank: int, pattern: str, score: float, context: str | None) -> Column:
    """Confirmed matches that reach the threshold as spans; places grow by the length of each gap and match."""

    def run(pair: Column) -> Column:
        gaps, found = pair["gaps"], pair["found"]
        ends = running(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i))), lambda x, y: x + y)
        spans = let(ends, lambda e: F.transform(found, lambda m, i: F.struct(F.get(e, i).alias("end"), m.alias("m"), i.alias("i"))))
        good = F.filter(spans, lambda s: _confirmed(kind, s["m"]))
        total = score
        if context:
            # what stands before a match: the gap, and as many earlier gaps and matches as the window may reach
            pieces = F.transform(found, lambda m, i: _tail(F.concat(F.get(gaps, i), m)))
            before = lambda p, i: _tail(F.concat_ws("", *[F.get(p, i - k) for k in range(-(-WINDOW // SHORTEST), 0, -1)], _tail(F.get(gaps, i))))
            confirmed = good
            good = let(pieces, lambda p: F.filter(confirmed, lambda s: before(p, s["i"]).rlike(context)))
            total += LIFT
        if total < THRESHOLD:
            return F.array().cast(f"array<{SPAN}>")
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (s["end"] - F.length(s["m"])).alias("start"), s["end"].alias("end"), F.lit(total).alias("score")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)).alias("found")), run)


def spans(text: Column) -> Column:
    """All spans of a text by start, then by kind as listed: array of (kind, rank, start, end, score)."""
    none = F.array().cast(f"array<{SPAN}>")
    base, more = [], []
    for rank, (kind, pattern, needs, score, context) in enumerate(KINDS):
        hint = F.contains(text, F.lit(needs)) if needs in ("@", "AKIA") else text.rlike(needs)
        (base if kind in BASE else more).append(F.when(hint, _placed(text, kind, rank, pattern, score, context)).otherwise(none))
    joined = let(F.concat(*base), lambda b: F.concat(b, *[_free(m, b) if KINDS[len(BASE) + i][0] in ("ssn", "local") else m for i, m in enumerate(more)]))
    by_start = F.transform(joined, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return F.array_sort(by_start)


def _free(some: Column, others: Column) -> Column:
    """The spans of `some` that overlap none of the others: of those that start before its end, none reaches beyond its start."""
    event = lambda at, other, reach, s: F.struct(at.alias("at"), F.lit(other).alias("other"), reach.alias("reach"), s.alias("span"))
    events = lambda c: F.array_sort(F.concat(F.transform(others, lambda s: event(s["start"], 1, s["end"], s)), F.transform(c, lambda s: event(s["end"], 0, F.lit(0), s))))
    reached = lambda e: let(running(F.transform(e, lambda x: x["reach"]), F.greatest), lambda r: F.transform(e, lambda x, i: F.struct(x["other"].alias("other"), F.get(r, i).alias("upto"), x["span"].alias("span"))))
    clear = lambda e: F.transform(F.filter(reached(e), lambda x: (x["other"] == 0) & (x["upto"] <= x["span"]["start"])), lambda x: x["span"])
    return let(some, lambda c: F.when((F.size(c) == 0) | (F.size(others) == 0), c).otherwise(let(events(c), clear)))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind))


def listing(found: Column, base_only: bool = False) -> Column:
    if base_only:
        found = F.filter(found, lambda s: s["rank"] < len(BASE))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with pii_spans."""
    return docs.select("*", let(F.coalesce(F.col(f"`{column}`"), F.lit("")), spans).alias("pii_spans"))


def mask(text: Column, found: Column) -> Column:
    """text with each run of overlapping spans replaced by <KIND> of its first span."""

    def replaced(reach: Column) -> Column:
        """reach: how far the spans up to each go; a run begins where a span starts at or beyond that of the ones before."""
        placed = F.transform(found, lambda s, i: F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        heads = F.filter(placed, lambda x: x["start"] >= x["at"])
        last = F.get(reach, F.size(reach) - 1)
        return let(heads, lambda h: F.concat(F.array_join(_pieces(text, h, F.lit(0), last), ""), F.substring(text, last + 1, F.greatest(F.length(text) - last, F.lit(0)))))

    return F.when(F.size(found) > 0, let(running(F.transform(found, lambda s: s["end"]), F.greatest), replaced)).otherwise(text)


def _pieces(text: Column, heads: Column, base: Column, last: Column, sizes: tuple[int, ...] = (BLOCK**2, BLOCK)) -> Column:
    """The text before each head, from its `at` on, and <KIND>. text begins at `base` and matters up to `last`.

    A substring is found by counting from the text's start, so the text of many heads is cut into that of groups first.
    """
    plain = F.transform(heads, lambda x: F.concat(F.substring(text, x["at"] - base + 1, x["start"] - x["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    if not sizes:
        return plain
    size, *rest = sizes

    def group(g: Column) -> Column:
        bounds = F.struct(F.get(heads, g * size)["at"].alias("a"), F.coalesce(F.get(heads, (g + 1) * size)["at"], last).alias("b"))
        part = lambda r: F.struct(F.substring(text, r["a"] - base + 1, r["b"] - r["a"]).alias("t"), F.slice(heads, g * size + 1, F.lit(size)).alias("h"), r["a"].alias("a"), r["b"].alias("b"))
        return let(bounds, lambda r: let(part(r), lambda p: _pieces(p["t"], p["h"], p["a"], p["b"], tuple(rest))))

    groups = F.sequence(F.lit(0), F.floor((F.size(heads) - 1) / size).cast("int"))
    return F.when(F.size(heads) <= size, _pieces(text, heads, base, last, tuple(rest))).otherwise(F.flatten(F.transform(groups, group)))


def mask_documents(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the spans of the text masked; the columns stay."""
    masked = let(
        F.struct(F.col(f"`{column}`").alias("t"), spans(F.coalesce(F.col(f"`{column}`"), F.lit(""))).alias("s")),
        lambda x: mask(x["t"], x["s"]),
    )
    return docs.select(*[masked.alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns])
