"""Personal data: patterned spans, and terms that disclose them, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
Their values are the protected entities. How strongly a term reveals one is
estimated from the corpus: with the entity's information content
IC(e) = -log2 p(e) and PMI(t, e) = log2 p(e|t) / p(e), a term discloses an
entity if PMI >= ALPHA * IC, which is p(e|t) >= p(e) ** (1 - ALPHA). A term
counts for an entity if it stands within CONTEXT_CHARS of it; p(e|t) divides the
different texts where it does by all different texts that hold the term, smoothed
towards p(e) by SMOOTHING texts. One text shows nothing about a term, as any word of
it stands beside the entity there: SUPPORT different texts must hold both, whatever
the size of the corpus. Every entity is judged. A disclosing term is removed where p(e|t) >= REMOVE_FROM, and else
generalised to the kind of the entity, wherever it stands in the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, sent_if_few, with_share

# The patterns. Loops are possessive and the runs they start with
# are entered at their front only (or where the last match ended), which finds
# the same matches in linear time and without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

ALPHA = 0.9
#: Texts that p(e) weighs in p(e|t).
SMOOTHING = 0.5
#: Different texts that must hold a term beside an entity.
SUPPORT = 2
REMOVE_FROM = 0.9
CONTEXT_CHARS = 100
MIN_TERM_CHARS = 4
#: Terms that are sent to all workers; more are joined by shuffle.
MAX_SENT_TERMS = 50_000
#: Rows that hold terms whose keys and terms are sent to all workers; more are joined by shuffle.
MAX_SENT_ROWS = 100_000
LETTERS = r"\p{L}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_NEEDED = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}


def _whole(context: Column, edge: str) -> Column:
    """context without the word at its outer edge, where the text goes on there."""
    return F.when(F.length(context) > CONTEXT_CHARS, F.regexp_replace(context, edge, "")).otherwise(context)


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """rows with a column for each kind: its valid spans as (start, stop, value, before, after).

    Positions are in code points; before and after are CONTEXT_CHARS of the text
    around, but for a word that their outer edge would cut.
    """
    t = F.col(text)
    none = F.array().cast("array<string>")
    found = rows.withColumns({f"_m_{k}": F.when(_NEEDED[k](t), F.regexp_extract_all(t, F.lit(_PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    found = found.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(t, _PATTERNS[k], -1)).otherwise(none) for k in KINDS})

    wide = F.lit(CONTEXT_CHARS + 1)

    def spans(kind: str) -> Column:
        matches, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>").alias("out"))

        def step(state: Column, i: Column) -> Column:
            match, gap = F.get(matches, i), F.get(gaps, i)
            start = state["at"] + F.length(gap)
            stop = start + F.length(match)
            # One character more than the context tells whether the edge cuts a word.
            before = F.right(F.concat(state["last"], F.right(gap, wide)), wide)
            # A match has two characters at least, so few matches fill the context.
            ahead = F.sequence(i + 1, F.least(i + 1 + CONTEXT_CHARS // 2, F.size(matches)))
            after = F.left(F.array_join(F.transform(ahead, lambda j: F.concat(F.left(F.get(gaps, j), wide), F.coalesce(F.left(F.get(matches, j), wide), F.lit("")))), ""), wide)
            span = F.struct(start.alias("start"), stop.alias("stop"), match.alias("value"), _whole(before, r"^(?:\p{L}+|\P{L})").alias("before"), _whole(after, r"(?:\p{L}+|\P{L})$").alias("after"))
            last = F.right(F.concat(before, F.right(match, wide)), wide)
            return F.struct(stop.alias("at"), last.alias("last"), F.when(_valid(kind, match), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

        return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), empty, step, lambda state: state["out"])).otherwise(empty["out"])

    out = found.withColumns({k: spans(k) for k in KINDS})
    return out.drop(*[f"_{x}_{k}" for x in "mg" for k in KINDS])


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def _row(key: Column, text: Column) -> Column:
    """What tells a row by id and text: 128 bits."""
    return F.struct(F.xxhash64(key, text).alias("a"), F.xxhash64(text, key).alias("b"))


def _terms(text: Column) -> Column:
    """Distinct lower-cased words of letters, long enough to tell."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+", -1), lambda w: F.length(w) >= MIN_TERM_CHARS))


def disclosing_terms(rows: DataFrame, text: str, spans: DataFrame) -> DataFrame:
    """(term, kind, p, action): terms that reveal an entity; spans is base_spans of rows with text_hash.

    All counts are of distinct texts. Of a term's entities the one it tells most of decides.
    """
    shared = with_share(rows, F.col("text_hash"))
    n_texts = shared.agg(F.round(F.sum("share")).alias("n"))
    hits = reduce(DataFrame.unionByName, [spans.where(F.size(k) > 0).select("text_hash", F.lit(k).alias("kind"), F.explode(k).alias("s")) for k in KINDS])
    hits = hits.select("text_hash", "kind", F.lower("s.value").alias("entity"), F.concat_ws(" ", "s.before", "s.after").alias("around"))
    known = hits.groupBy("kind", "entity").agg(F.count_distinct("text_hash").alias("c_e"))
    near = hits.join(known, ["kind", "entity"]).select("kind", "entity", "c_e", "text_hash", F.explode(_terms(F.col("around"))).alias("term"))
    joint = near.groupBy("kind", "entity", "c_e", "term").agg(F.count_distinct("text_hash").alias("c_te")).where(F.col("c_te") >= SUPPORT)
    joint = materialise(joint, "joint")
    # Every term is counted, added up task by task before it moves; only then is it met with the candidates.
    # Copies of a text add up to one.
    c_t = shared.select("share", F.explode(_terms(F.col(text))).alias("term")).groupBy("term").agg(F.round(F.sum("share")).alias("c_t"))
    # Letters right beside a match may be part of it, so that the term has no count of its own.
    scored = joint.join(c_t, "term").crossJoin(n_texts).withColumn("p", (F.col("c_te") + SMOOTHING * F.col("c_e") / F.col("n")) / (F.greatest("c_t", "c_te") + SMOOTHING))
    content = F.log2(F.col("n") / F.col("c_e"))
    shown = scored.where((F.log2(F.col("p")) + content >= F.lit(ALPHA) * content) & (content > 0))
    best = shown.groupBy("term").agg(F.max_by(F.struct("kind", "p"), F.struct("p", "kind")).alias("b"))
    return best.select("term", "b.kind", "b.p", F.when(F.col("b.p") >= REMOVE_FROM, "remove").otherwise("generalise").alias("action"))


def term_spans(rows: DataFrame, text: str, key: str, terms: DataFrame) -> DataFrame:
    """(key, spans): where the terms stand in the rows that hold any, as (start, stop, kind, action)."""
    words = rows.select(key, F.explode(_terms(F.col(text))).alias("term"))
    small = terms.limit(MAX_SENT_TERMS + 1).count() <= MAX_SENT_TERMS
    hit = words.join(F.broadcast(terms) if small else terms, "term")
    own = materialise(hit.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("term", F.struct("kind", "action")))).alias("told")), "told")
    t = F.col(text)
    # Few rows hold a term: they are picked where they are read, and only then reduced to one of each key.
    parts = rows.join(sent_if_few(own, MAX_SENT_ROWS), key).dropDuplicates([key]).select(key, "told", F.regexp_extract_all(t, F.lit(LETTERS), F.lit(0)).alias("words"), F.transform(F.split(t, LETTERS, -1), lambda g: F.length(g)).alias("gaps"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,kind:string,action:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gaps"]
        stop = start + F.length(x["words"])
        told = F.try_element_at(F.col("told"), F.lower(x["words"]))
        span = F.struct(start.alias("start"), stop.alias("stop"), told["kind"].alias("kind"), told["action"].alias("action"))
        return F.struct(stop.alias("at"), F.when(told.isNotNull(), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip("words", "gaps"), lambda x: x["words"].isNotNull())
    return parts.select(key, F.aggregate(pairs, empty, step, lambda state: state["out"]).alias("spans"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, row, email, ip, card, phone, term): all spans of every row, each kind by start.

    Null text counts as empty. row is a hash of id and text: rows alike in both
    share it and their spans; repeated and null ids are rows like all others.
    An empty table gives an empty result, and all texts without spans are rows too;
    other columns are not looked at. Texts are read whole, however long. Entities and terms are counted when this is called.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"row": _row(F.col("id"), F.col("text")), "text_hash": F.xxhash64("text")})
    base = materialise(base_spans(rows, "text").drop("text"), "spans")
    terms = materialise(disclosing_terms(rows, "text", base), "terms")
    where = term_spans(rows.select("row", "text"), "text", "row", terms).withColumnRenamed("spans", "term")
    return base.join(where, "row", "left").select(F.col("id").alias(id_col), "row", *KINDS, "term")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row."""
    found = find_personal_data(docs)
    base = F.concat(*[_listed(F.col(k), k) for k in KINDS])
    more = F.coalesce(_listed(F.col("term"), "term"), F.array().cast("array<string>"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans")
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data and disclosing terms replaced in text_col.

    Base spans become their kind in brackets, generalised terms the kind with
    "context", removed terms nothing. Where spans overlap, the one that starts
    first (then the longest) stands. Null texts stay null. Rows are rewritten one by
    one, repeated ones alike; an empty table gives an empty one; no column is lost.
    """
    names = docs.columns
    found = find_personal_data(docs, id_col, text_col).dropDuplicates(["row"])

    def swapped(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), F.lit(f"[{kind}]").alias("by")))

    base = [swapped(k) for k in KINDS]
    more = F.transform(F.coalesce("term", F.array().cast("array<struct<start:int,stop:int,kind:string,action:string>>")), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit(" context]"))).alias("by")))
    swaps = found.select("row", F.array_sort(F.concat(*base, more)).alias("swaps")).where(F.size("swaps") > 0)
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    joined = keyed.withColumn("row", _row(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")))).join(swaps, "row", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]), s["by"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct((-s["less"]).alias("at"), F.array_append(state["out"], piece).alias("out")))

    whole = F.aggregate("swaps", start, step, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(F.col(text), state["at"] + 1, F.length(text))))
    return joined.select(*[F.when(F.col("swaps").isNull(), F.col(f"c{i}")).otherwise(whole).alias(f"c{i}") if f"c{i}" == text else F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
