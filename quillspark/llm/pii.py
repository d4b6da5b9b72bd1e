r"""Personal data by bootstrapped contextual extraction, in native expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers with their places.
These are the seeds. Every identifier of a text (a word with ``@``, or a run of digit groups
with at least ``MIN_DIGITS`` digits) induces lexical patterns from the words around it: the
label before it (``word:``, ``word =``, ``word #``), the two words before it, and the words
on both sides. Patterns and values form a graph with one row per distinct pair. A pattern's
score for a kind is the sum of the scores of its distinct values of that kind, over their
number and one; a pattern is accepted from ``ACCEPT`` on if ``MIN_SUPPORT`` values of its kind
support it. A value that is no seed takes the score and kind of its best accepted pattern,
and then supports others: each round may accept patterns that only discovered values support.
After ``ROUNDS`` rounds, identifiers in accepted patterns become spans of their kind, if they
have its shape (``@`` for e-mail, digit groups for the others). Base spans always stay; added
ones never overlap them.

The graph is aggregated and written before it is joined, so a pattern in a third of all
documents costs its distinct values, and Spark can split a frequent key. Places are running
sums over short slices, and redaction works on short pieces of a text, so work grows with a
text's length and not with its square.

Defined cases: null text is empty: no spans; ``redact`` leaves it null. ``find_personal_data``
leaves rows with a null id out, and of rows that repeat an id takes the smallest text;
``redact`` treats every row by its own text, whatever ids there are. Contexts are looked for in
the ``CONTEXT`` characters on each side. Empty table: empty result. Other columns are kept by
``redact`` and ignored else, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch

KINDS = ["email", "ip", "card", "phone"]
# A run of a class is tried from its start only (or where the last match ended): a later start
# in the same run fails as the first did. Possessive repeats take what greedy ones would, and
# are matched without recursion, however long a text is.
_NAME = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind's pattern to be worth running.
MAYBE = {"email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
MIN_DIGITS = 5
_WORD = r"[^\s\x22'<>(),;:=@]"
#: Identifiers: a word with @, or digit groups with single spaces between.
IDENTIFIER = (rf"(?:(?<!{_WORD})|\G){_WORD}++@[^\s\x22'<>(),;@]++"
              rf"|(?<![0-9A-Za-z])(?=(?:[().+/\x20-]*+[0-9]){{{MIN_DIGITS}}})[+(]?[0-9][0-9().+/-]*+(?:\x20[0-9(][0-9().+/-]*+)*+")
MAYBE_IDENTIFIER = rf"@|(?:[0-9][().+/\x20-]{{0,4}}){{{MIN_DIGITS - 1}}}[0-9]"
CONTEXT = 48
LABEL = r"([\p{L}_]{2,})[ ]?[:=#][ ]?[\x22']?$"
TWO_WORDS = r"(?:^|\s)(\S+\s+\S+)\s+$"
LAST_WORD, FIRST_WORD = r"(?:^|\s)(\S+)\s+$", r"^\s+(\S+)"
ROUNDS, ACCEPT, MIN_SUPPORT = 3, 0.6, 3
SPAN = "array<struct<s:bigint,k:int,e:bigint>>"
#: Elements of a slice that a running sum works on, and characters of a piece of a text.
SLICE, PIECE = 64, 4096


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def scan(items: Column, first: Column, step, kind: str) -> Column:
    """An ordered scan: ``step(state, item)`` gives (state, output), ``kind`` is the type of the
    array of outputs. The states at the beginnings of short slices come first; then each slice
    gathers its own outputs, because what is gathered is copied at each step."""

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["p"], x)
        return F.struct(state.alias("p"), F.concat(acc["o"], F.array(out)).alias("o"))

    def upto(acc: Column, part: Column) -> Column:
        return F.concat(acc, F.array(F.aggregate(part, F.get(acc, F.size(acc) - 1), lambda p, x: step(p, x)[0])))

    def outputs(cut: Column, states: Column) -> Column:
        return F.flatten(F.transform(cut, lambda part, i: F.aggregate(part, F.struct(F.get(states, i).alias("p"), empty(kind).alias("o")), inner, lambda acc: acc["o"])))

    def whole(a: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(SLICE)), lambda i: F.slice(a, i + 1, SLICE))
        done = let(cut, lambda c: let(F.aggregate(c, F.array(first), upto), lambda p: outputs(c, p)))
        return F.when(F.size(a) > 0, done).otherwise(empty(kind))

    return let(items, whole)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def add(a: Column, i: Column) -> Column:
            x = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return a + F.when(x > 9, x - 9).otherwise(x)

        return F.length(d).between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add) % 10 == 0)

    return let(_digits(m), total)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """Places of the matches with what stands around them, as array<struct<s,e,m,l,r>>. The text
    between matches and the matches alternate, so places are running sums of lengths."""

    def pieces(between: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).cast("long").alias("n"), m.alias("m"), F.right(F.get(between, i), F.lit(CONTEXT)).alias("l"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("r")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["n"]
        end = start + F.length(x["m"])
        return end, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))

    return scan(let(F.split(text, pattern, -1), pieces), F.lit(0).cast("long"), step, "array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>")


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e>> of all kinds, by start, then kind as listed; places in code points."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(text.rlike(MAYBE[kind]), spans).otherwise(empty(SPAN))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _kinds(places: Column, base: Column) -> Column:
    """The kind of a base span that overlaps each of ``places`` (disjoint, in order), else null."""
    event = "array<struct<s:bigint,t:int,e:bigint,k:int,i:int>>"
    a = F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("t"), x["e"].alias("e"), x["k"].alias("k"), F.lit(-1).alias("i")))
    b = F.transform(places, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("t"), x["e"].alias("e"), F.lit(None).cast("int").alias("k"), i.alias("i")))

    def step(before):
        def f(state: Column, x: Column) -> tuple[Column, Column]:
            near = F.when(before, state["at"] > x["s"]).otherwise(state["at"] < x["e"])
            k = F.when(x["t"] == 0, x["k"]).otherwise(F.coalesce(x["k"], F.when(near, state["k"])))
            new = F.when(before, (x["t"] == 0) & (x["e"] > state["at"])).otherwise(x["t"] == 0)
            place = F.when(before, x["e"]).otherwise(x["s"])
            now = F.struct(F.when(new, place).otherwise(state["at"]).alias("at"), F.when(new, x["k"]).otherwise(state["k"]).alias("k"))
            return now, F.struct(x["s"].alias("s"), x["t"].alias("t"), x["e"].alias("e"), k.alias("k"), x["i"].alias("i"))

        return f

    def start(at: int) -> Column:
        return F.struct(F.lit(at).cast("long").alias("at"), F.lit(None).cast("int").alias("k"))

    forth = scan(F.array_sort(F.concat(a, b)), start(-1), step(F.lit(True)), event)
    back = scan(F.reverse(forth), start(1 << 62), step(F.lit(False)), event)
    return F.transform(F.filter(F.reverse(back), lambda x: x["t"] == 1), lambda x: x["k"])


IDENTIFIERS = "array<struct<s:bigint,e:bigint,value:string,l:string,r:string,kind:int>>"


def identifiers(text: Column, base: Column) -> Column:
    """array<struct<s,e,value,l,r,kind>>: identifiers with what stands around them, and the kind
    of the base span that they overlap."""

    def trimmed(x: Column) -> Column:
        value = F.rtrim(x["m"], F.lit(".!?(+/-"))
        return F.struct(x["s"].alias("s"), (x["s"] + F.length(value)).alias("e"), value.alias("value"), F.lower(x["l"]).alias("l"), F.lower(x["r"]).alias("r"))

    def named(found: Column) -> Column:
        kinds = F.when(F.size(base) > 0, _kinds(found, base)).otherwise(F.transform(found, lambda x: F.lit(None).cast("int")))
        return F.zip_with(found, kinds, lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), x["l"].alias("l"), x["r"].alias("r"), k.alias("kind")))

    return F.when(text.rlike(MAYBE_IDENTIFIER), let(F.transform(located(text, IDENTIFIER), trimmed), named)).otherwise(empty(IDENTIFIERS))


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of an identifier from the lower-cased text around it."""
    label, two = F.regexp_extract(left, LABEL, 1), F.regexp_replace(F.regexp_extract(left, TWO_WORDS, 1), r"\s+", " ")
    last, first = F.regexp_extract(left, LAST_WORD, 1), F.regexp_extract(right, FIRST_WORD, 1)
    found = F.array(F.when(label != "", F.concat(F.lit("label "), label)), F.when(two != "", F.concat(F.lit("after "), two)),
                    F.when((last != "") & (first != ""), F.concat(F.lit("between "), last, F.lit(" "), first)))
    return F.filter(found, lambda x: x.isNotNull())


def _shaped(value: Column, kind: Column) -> Column:
    return (kind == 0) == value.contains("@")


def accepted_patterns(graph: DataFrame) -> DataFrame | None:
    """(pattern, kind, score): the bootstrap over staged, distinct (pattern, value, kind) rows,
    kind null for no seed; None where no pattern is accepted."""
    seeds = scratch.stage(graph.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    good, known = None, seeds
    for _ in range(ROUNDS):
        of = [F.col("kind") == k for k in range(len(KINDS))]
        each = graph.select("pattern", "value").join(known, "value", "left")
        by = each.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(F.when(c, F.col("score"))).alias(f"s{k}") for k, c in enumerate(of)), *(F.count_if(c & (F.col("score") >= ACCEPT)).alias(f"c{k}") for k, c in enumerate(of)))
        best = F.array_max(F.array(*(F.struct(F.coalesce(f"s{k}", F.lit(0.0)).alias("s"), F.lit(-k).alias("k"), F.col(f"c{k}").alias("c")) for k in range(len(KINDS)))))
        by = by.select("pattern", "n", best.alias("b")).select("pattern", (-F.col("b.k")).alias("kind"), (F.col("b.s") / (F.col("n") + 1)).alias("score"), F.col("b.c").alias("support"))
        good = scratch.stage(by.filter((F.col("score") >= ACCEPT) & (F.col("support") >= MIN_SUPPORT)).drop("support"), "patterns")
        if good.isEmpty():
            return None
        new = graph.filter("kind is null").select("pattern", "value").join(good, "pattern").filter(_shaped(F.col("value"), F.col("kind")))
        new = new.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
        known = scratch.stage(seeds.unionByName(new.join(seeds, "value", "left_anti")), "known")
    return good


def _added(rows: DataFrame, key: str) -> DataFrame:
    """(key, added): spans that the bootstrap adds, from staged (key, ids) rows."""
    each = rows.filter(F.size("ids") > 0).select(key, F.explode("ids").alias("x")).select(key, "x.s", "x.e", "x.value", "x.kind", patterns(F.col("x.l"), F.col("x.r")).alias("patterns"))
    each = scratch.stage(each, "instances")
    graph = scratch.stage(each.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    good = accepted_patterns(graph)
    if good is None:
        return rows.select(key, empty(SPAN).alias("added")).limit(0)
    new = each.filter("kind is null").select(key, "s", "e", "value", F.explode("patterns").alias("pattern")).join(good.withColumnRenamed("kind", "k"), "pattern").filter(_shaped(F.col("value"), F.col("k")))
    new = new.groupBy(key, "s", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    return new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("b.k")).alias("k"), "e"))).cast(SPAN).alias("added"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): both array<struct<s,k,e>>, k indexing KINDS."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = scratch.one_row_per_id(d, "doc_id").select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    d = scratch.stage(d.select("doc_id", "base", identifiers(F.col("text"), F.col("base")).alias("ids")), "spans")
    added = _added(d, "doc_id")
    return d.select("doc_id", "base").join(added, "doc_id", "left").withColumn("added", F.coalesce("added", empty(SPAN)))


def span_list(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with ordered ``spans`` replaced by their kinds in brackets; overlapping ones as one,
    under the first one's kind. A piece of the text is put together from the spans that touch it."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(c: Column, i: Column, spans: Column) -> Column:
        low = i.cast("long") * PIECE

        def step(acc: Column, x: Column) -> Column:
            new = F.concat(acc["o"], F.substr(c, (acc["p"] - low + 1).cast("int"), (x["s"] - acc["p"]).cast("int")), F.get(kinds, x["k"]))
            return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] >= acc["p"], new).otherwise(acc["o"]).alias("o"))

        def joined(near: Column) -> Column:
            done = F.aggregate(near, F.struct(low.alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], F.substr(c, (a["p"] - low + 1).cast("int"))))
            return F.when(F.size(near) > 0, done).otherwise(c)

        return let(F.filter(spans, lambda x: (x["s"] < low + PIECE) & (x["e"] > low)), joined)

    def whole(spans: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda c, i: piece(c, i, spans))
        return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)

    return let(spans, whole)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets. All rows stay, and each
    is treated by its own text. Only rows with identifiers are moved."""
    names = ["row", "base", "ids", "added"]
    while any(f"_{n}" in docs.columns for n in names):
        names = [f"_{n}" for n in names]
    row, base, ids, added = (f"_{n}" for n in names)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    d = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(base, base_spans(t))
    d = scratch.stage(d.withColumn(ids, identifiers(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(base))), "spans")
    new = _added(d.select(row, F.col(ids).alias("ids")), row).select(row, F.col("added").alias(added))
    some = d.filter(F.size(ids) > 0).join(new, row, "left").withColumn(added, F.coalesce(added, empty(SPAN)))
    every = d.filter(F.size(ids) == 0).withColumn(added, empty(SPAN)).unionByName(some)
    every = every.withColumn(base, F.array_sort(F.concat(base, added)))
    return every.withColumn(text, replaced(F.col(text), F.col(base))).select(*docs.columns)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    d = find_personal_data(scratch.table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.array_sort(F.concat("base", "added"))).alias("spans"))
