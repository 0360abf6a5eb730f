"""Personal data: patterns, then the words that would give a masked value away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Protected
entities c are the distinct values and, as most values are rare, what values
share: an address's domain and the words before its @, an IP address's network,
the first six digits of phone and card numbers. An entity's information content
is IC(c) = log2(N / df(c)) over all N rows, and a term t tells
PMI(c; t) = log2(N * df(c, t) / (df(c) * (df(t) + ``smooth``))) bits of it; the
smoothing leaves rare terms that met a common entity by chance alone. A term
that tells at least ``disclosure`` of IC(c), and was seen with c in at least
``support`` rows, is hidden in the rows that hold c: it is generalised to a tag,
or removed where it occurs with c only. A value or word in fewer rows than
``support`` tells nothing that can be estimated, so beside it only what goes
with a shared part is hidden. Counts are over all rows, copies included. Only
built-in expressions run.

Cases: a null text counts as empty and stays null when sanitised; repeated
rows are each counted and returned; an empty table gives an empty table; other
columns are carried along whatever they are called; terms are runs of two or
more letters, digits and underscores that begin with a letter, so a run of a
script without spaces is one term. Texts of any length and any number of spans
are covered in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.session import written
from .expr import before, largest, let, total, whole
from .tables import joined

# Fixed patterns. Each starts at the beginning of a run or where the last match
# ended, and possessively, so that long runs without a match cost one pass.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term", "cut"]
TERM = r"\p{L}[\p{L}\p{N}_]++"
CHUNK = 1024  # code points of a text that are cut together
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


@dataclass(frozen=True)
class Disclosure:
    disclosure: float = 0.9
    support: int = 3
    smooth: float = 1.0


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, in code points."""

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: (F.char_length(m) + F.char_length(F.get(gaps, i))).cast("long"))
        return let(before(sizes, total), lambda b: F.transform(found, lambda m, i: let(
            F.get(b, i) + F.char_length(F.get(gaps, i)),
            lambda s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value")))))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern).alias("g")),
               lambda x: placed(x["f"], x["g"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def points(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return let(F.filter(F.split(digits, ""), lambda c: c != ""), lambda a: total(F.transform(a, lambda c, i: points(c, i, F.size(a)))) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.char_length(p) <= 3) & (F.concat(F.lit("0"), p).try_cast("int") <= 255)
        return F.forall(F.split(value, r"\."), lambda p: part(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all kinds of one text, sorted by start and kind; ``value`` names the entity."""
    none = F.array().cast(f"array<{SPAN}>")
    kinds = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        name = F.lower if kind == "email" else (lambda v: v) if kind == "ip" else _digits
        spans = lambda t, kind=kind, no=no, name=name, pattern=pattern: F.transform(
            F.filter(_matches(t, pattern), lambda m: _valid(kind, m["value"])),
            lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end"), F.concat(F.lit(kind + " "), name(m["value"])).alias("value")))
        likely = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike(pattern))
        kinds.append(F.when(likely, spans(text)).otherwise(none))
    return F.array_sort(F.concat(*kinds))


def covered(text: Column, spans: Column, cover) -> Column:
    """The text with each span replaced by ``cover(kind, length)``; of overlapping spans the later ones cover what is left.

    What lies between spans is cut from chunks of the text: a cut from the
    whole text would go over all that is before it.
    """
    ends = before(F.transform(spans, lambda s: s["end"]), largest)

    def cut(chunks: Column, start: Column, size: Column | None = None) -> Column:
        first = F.floor(start / CHUNK)
        many = F.size(chunks) if size is None else F.floor((start + size) / CHUNK) - first + 1
        some = F.array_join(F.slice(chunks, (first + 1).cast("int"), many.cast("int")), "")
        return F.substr(some, (start - first * CHUNK + 1).cast("int"), *([] if size is None else [size.cast("int")]))

    def piece(chunks: Column, s: Column, last: Column) -> Column:
        start = F.greatest(s["start"], last)
        return F.when(start < s["end"], F.concat(cut(chunks, last, F.greatest(s["start"] - last, F.lit(0))), cover(s["kind"], s["end"] - start))).otherwise("")

    def spliced(x: Column) -> Column:
        rest = largest(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, lambda s, i: piece(x["chunks"], s, F.get(x["ends"], i))), ""), cut(x["chunks"], rest))

    parts = F.struct(ends.alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, spliced))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces over the spans: words stay at their places."""
    return covered(text, spans, lambda _, n: F.repeat(F.lit(" "), n.cast("int")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _entities(spans: Column) -> Column:
    """The values of the spans and what they may share with others."""

    def of(value: Column) -> Column:
        rest = F.substring_index(value, " ", -1)
        words = F.filter(F.split(F.substring_index(rest, "@", 1), "[^a-z]+"), lambda w: F.char_length(w) > 2)
        parts = F.when(value.startswith("email "), F.concat(F.array(F.concat(F.lit("domain "), F.substring_index(rest, "@", -1))), F.transform(words, lambda w: F.concat(F.lit("word "), w))))
        parts = parts.when(value.startswith("ip "), F.array(F.concat(F.lit("net "), F.substring_index(rest, ".", 3))))
        return F.concat(F.array(value), parts.otherwise(F.array(F.concat(F.substring_index(value, " ", 1), F.lit(" from "), F.substring(rest, 1, 6)))))

    return F.array_distinct(F.flatten(F.transform(spans, lambda s: of(s["value"]))))


def _telling_terms(rows: DataFrame, limits: Disclosure) -> DataFrame | None:
    """(rid, hidden): the terms that tell too much in each row; None when there are none."""
    n = rows.count()
    having = rows.where(F.size("spans") > 0)
    each = having.select("rid", F.explode(_entities(F.col("spans"))).alias("entity"))
    known = written(each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where((F.col("n_c") >= limits.support) & (F.col("n_c") < n)), "entities")
    if known.isEmpty():
        return None
    # Terms are counted before anything is joined, so a common one is a sum per task.
    seen_in = F.when(F.size("spans") > 0, _blanked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    terms = written(rows.select("rid", (F.size("spans") > 0).alias("having"), _terms(seen_in).alias("t")).select("rid", "having", F.explode("t").alias("term"))
                    .groupBy("term").agg(F.count(F.lit(1)).alias("n_t"), F.count_if("having").alias("n_having")).where(F.col("n_having") >= limits.support), "terms")
    held = joined(each, known, ["entity"]).groupBy("rid").agg(F.collect_list(F.struct("entity", "n_c")).alias("held"))
    held = written(having.join(held, "rid").select("rid", "held", _terms(_blanked(F.col("text"), F.col("spans"))).alias("t")), "held")
    bits = lambda count: F.log2(F.lit(float(n)) / count)
    told = lambda n_ct: bits(F.col("n_c") * (F.col("n_t") + limits.smooth) / n_ct)
    needed = limits.disclosure * bits(F.col("n_c"))
    seen = joined(held.select("rid", "held", F.explode("t").alias("term")), terms.drop("n_having"), ["term"])
    seen = seen.select("rid", "term", "n_t", F.explode("held").alias("h")).select("rid", "term", "n_t", "h.*")
    # Most terms are too common to tell enough of an entity even if they were with it wherever they can be.
    seen = written(seen.where(told(F.least("n_c", "n_t")) >= needed), "seen")
    pairs = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    telling = pairs.where((F.col("n_ct") >= limits.support) & (told(F.col("n_ct")) >= needed))
    telling = written(telling.select("entity", "term", (F.col("n_t") == F.col("n_ct")).alias("alone")), "telling")
    if telling.isEmpty():
        return None
    hidden = joined(seen.select("rid", "entity", "term"), telling, ["entity", "term"])
    each = hidden.groupBy("rid", "term").agg(F.max("alone").alias("alone"))
    lists = [F.collect_list(F.when(F.col("alone") if cut else ~F.col("alone"), F.col("term"))).alias(k) for k, cut in (("term", False), ("cut", True))]
    return each.groupBy("rid").agg(*lists)


def find(docs: DataFrame, limits: Disclosure = Disclosure(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows as ``row`` with ``text``, ``base`` (pattern spans) and ``spans`` (all), both arrays of (start, kind, end, value)."""
    carried = docs.columns if keep is None else keep
    t = whole(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), t.alias("text"), base_spans(t).alias("spans"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")
    telling = _telling_terms(rows, limits)
    plain = rows.select("row", "text", F.col("spans").alias("base"), "spans")
    if telling is None:
        return plain
    some, none = rows.where(F.size("spans") > 0).join(telling, "rid", "left"), plain.where(F.size("base") == 0)

    def marked(no: int) -> Column:
        kind = KINDS[no]
        of = lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end"), F.lower(m["value"]).alias("value"))
        return lambda m: F.transform(F.filter(m, lambda x: F.array_contains(F.col(kind), F.lower(x["value"]))), of)

    found = let(_matches(_blanked(F.col("text"), F.col("spans")), TERM), lambda m: F.concat(marked(4)(m), marked(5)(m)))
    more = F.when(F.col("term").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", found)))
    return some.select("row", "text", F.col("spans").alias("base"), more.alias("spans")).unionByName(none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, limits: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """``docs`` with values and generalised terms as tags such as ``[email]``, and cut terms gone; columns as they were."""
    tags = F.array(*[F.lit("" if k == "cut" else f"[{k}]") for k in KINDS])
    found = find(docs, limits, text)
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), covered(F.col("text"), F.col("spans"), lambda kind, _: F.get(tags, kind)))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
