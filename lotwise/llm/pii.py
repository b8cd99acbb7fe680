"""Personal data, and the terms with it that give it away: information-theoretic sanitisation in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_name, stored

#: What the base kinds are. Each pattern finds the same leftmost matches as the plain form
#: above it, but can't run back over long runs: \G is the end of the last match.
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)          each part at most 255
#: card   [0-9]([\x20-]?[0-9])+                         12 to 19 digits that pass Luhn
#: phone  \+[0-9][\x20().0-9-]+[0-9]                    9 to 15 digits
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold for a kind to be possible at all; None: no quick test.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
#: Stands for a character of an email in what is searched for words.
HIDDEN = "\uffff"
#: Matches are placed in slices, as appending to one array costs its length each time.
SLICE = 128
WORD = r"\p{L}{4,}+"
#: A word that touches nothing hidden.
OUTSIDE = rf"(?<![\p{{L}}{HIDDEN}])" + WORD + f"(?!{HIDDEN})"


def pieces(text: Column, regex: Column) -> Column:
    """What stands before each match, and the match; at the end, null for the match."""
    return F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), lambda a, b: F.struct(a.alias("gap"), b.alias("value")))


def placed(text: Column, pattern: str | Column, rank: int) -> Column:
    """All matches with their code-point offsets: the pieces between matches give the gaps.

    Offsets count up within slices of the matches first; then each slice is moved by the length of those before it.
    """
    found = F.filter(pieces(text, F.lit(pattern) if isinstance(pattern, str) else pattern), lambda x: x["value"].isNotNull())
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["end"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.struct((start + F.length(x["value"])).alias("end"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(by: Column):
        return lambda x: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["end"] + by).alias("end"), x["value"].alias("value"))

    slices = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SLICE).cast("int")), lambda i: F.aggregate(F.slice(x, i * SLICE + 1, SLICE), empty, add))
    none = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("out"))
    joined = lambda x: F.aggregate(slices(x), none, lambda acc, part: F.struct((acc["end"] + part["end"]).alias("end"), F.concat(acc["out"], F.array(F.transform(part["out"], moved(acc["end"])))).alias("out")), lambda acc: F.flatten(acc["out"]))
    # through a transform, so that the matches are found once
    return F.when(F.size(found) > 0, F.transform(F.array(found), joined)[0]).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    r = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(r, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)),
    "card": lambda v: F.length(digits(v)).between(12, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def of_kind(kind: str):
    return lambda s: VALID[kind](s["value"])


def of_rank(rank: int):
    return lambda s: s["rank"] == rank


def base_spans(text: Column) -> Column:
    """All valid base spans, by start, then kind."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.filter(placed(text, pattern, rank), of_kind(kind))
        may = F.instr(text, NEEDS[kind]) > 0 if NEEDS[kind] else text.isNotNull()
        found.append(F.when(may, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def hidden(text: Column) -> Column:
    """The text with all characters of emails hidden, at the same places. No other base value has letters."""
    return F.array_join(F.transform(pieces(text, F.lit(PATTERNS["email"])), lambda x: F.concat(x["gap"], F.coalesce(F.repeat(F.lit(HIDDEN), F.length(x["value"])), F.lit("")))), "")


def outside_words(text: Column) -> Column:
    """The distinct words, as they are written, that touch no email."""
    bare = F.when(F.instr(text, "@") > 0, F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(HIDDEN))).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(OUTSIDE), F.lit(0)))


def doc_set(doc: list[str]) -> list[Column]:
    """Aggregates that tell sets of documents apart: their number and two hashes."""
    return [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(*doc, F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]]


def find_private(docs: DataFrame, bits: float = 5.0, share: float = 0.5, remove_at: float = 0.9, least: int = 2, informed: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every whole text and the terms with them that disclose an entity.

    An entity is a base value (kind and lower-cased text). A term is a lower-cased word of four
    or more letters; those anywhere in a document with an entity that touch no email co-occur with it. Over all
    documents, n_e counts those with the entity, n_t those with the term anywhere, and n_te
    those where they co-occur; N is the number of documents. The term discloses the entity when

        log2(n_te * N / (n_t * n_e)) >= min(bits, informed * log2(N / n_e))   and   n_te / n_t >= share   and   n_te >= least,

    so a single document proves nothing, and an entity in many documents asks for fewer bits, as
    log2(N / n_e) is all that a term can tell of it; of one in all documents nothing can be told. Every occurrence
    of the term in documents with that entity becomes a span of kind "term": to be removed where
    n_te / n_t >= remove_at, else to be generalised. Entities that stand in the same documents are tested as one, and so are terms
    that stand in the same ones of these and are as frequent, so a list of many entities and words that two documents share is one test.

    Returns doc_id, text_hash, base (spans by start, then kind), terms (start, rank, end,
    value: "remove" or "generalise"). Null and empty texts have no spans. Rows with equal id and
    text are one document in the counts and get equal results. Other columns are ignored; an
    empty table gives no rows. Nothing is capped; what is shuffled are counts, hashes, the texts and words of documents with
    base values, and a row for each word and task in the document counts.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(text).alias("base"))
    found = found.select("doc_id", "text_hash", F.when(text.isNull(), F.array().cast(SPAN)).otherwise(F.col("base")).alias("base"), "text")
    kept = stored(found.select("doc_id", "text_hash", "base", F.when(F.size("base") > 0, text).alias("text"), F.when(F.size("base") > 0, outside_words(text)).otherwise(F.array().cast("array<string>")).alias("words")), "pii")

    doc = [F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")]
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))
    forms = kept.select("doc_id", "text_hash", F.explode("words").alias("form")).distinct().withColumn("term", F.lower("form"))
    entities = kept.select("doc_id", "text_hash", F.explode("base").alias("s")).select("doc_id", "text_hash", F.xxhash64("s.rank", F.lower("s.value")).alias("entity")).distinct()
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))
    # repeated rows are one document: what they count too much is taken off
    repeats = kept.groupBy("doc_id", "text_hash").agg((F.count("*") - 1).alias("more")).where("more > 0").select(*doc, "more")
    terms = rows.select(F.explode(words).alias("term"), F.lit(1).cast("long").alias("n"))
    total = kept.agg(F.count("*").alias("n"))
    if not repeats.isEmpty():
        again = rows.withColumn("text_hash", F.xxhash64("text")).join(repeats, same).dropDuplicates(["doc_id", "text_hash"])
        terms = terms.unionByName(again.select(F.explode(words).alias("term"), (-F.col("more")).alias("n")))
        total = kept.select("doc_id", "text_hash").distinct().agg(F.count("*").alias("n"))
    n_t = terms.groupBy("term").agg(F.sum("n").alias("n_t")).where(F.col("n_t") >= least)
    pair = ["doc_id", "text_hash"]
    e_set, t_set = F.struct("n", "x1", "x2").alias("e_set"), F.struct("n_t", "x1", "x2").alias("t_set")
    e_sets = entities.groupBy("entity").agg(*doc_set(pair)).where(F.col("n") >= least).select("entity", e_set)
    held = entities.join(e_sets, "entity").select(*doc, "e_set").distinct()
    with_entity = forms.select(*pair, "term").distinct()
    # n_te is at most the documents with the term and any entity
    t_sets = with_entity.groupBy("term").agg(*doc_set(pair)).where(F.col("n") >= least).join(n_t, "term").where(F.col("n") >= F.col("n_t") * share).select("term", t_set)
    named = forms.join(t_sets, "term").select(*pair, "form", "t_set")
    # n_te is at most n_e, so a term in more documents than that allows can't reach the share
    pairs = named.select(*pair, "t_set").distinct().join(held, same & (F.col("t_set.n_t") * share <= F.col("e_set.n")))
    rates = pairs.groupBy("e_set", "t_set").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= least).crossJoin(F.broadcast(total))  # one row
    shared = F.col("n_te") / F.col("t_set.n_t")
    most = F.log2(F.col("n") / F.col("e_set.n"))
    told = rates.where((most > 0) & (F.log2(F.col("n_te") * F.col("n") / F.col("t_set.n_t") / F.col("e_set.n")) >= F.least(F.lit(bits), informed * most)) & (shared >= share)).select("e_set", F.col("t_set").alias("_t"), F.when(shared >= remove_at, "remove").otherwise("generalise").alias("value"))
    marked = held.join(told, "e_set").groupBy("_d", "_h", "_t").agg(F.max("value").alias("value"))  # "remove" is the stronger
    marked = named.join(marked, same & (F.col("t_set") == F.col("_t"))).groupBy(*doc).agg(F.map_from_entries(F.collect_list(F.struct("form", "value"))).alias("actions"))
    out = kept.drop("words").join(marked, same, "left")
    hits = F.filter(placed(hidden(text), OUTSIDE, KINDS.index("term")), lambda t: F.map_contains_key("actions", t["value"]))
    terms = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), F.element_at("actions", t["value"]).alias("value")))
    return out.select("doc_id", "text_hash", "base", F.when(F.col("actions").isNotNull(), terms).otherwise(F.array().cast(SPAN)).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with base values replaced by their kind in brackets, generalised terms by [TERM], and removed ones gone.

    Overlapping spans become one, named by the first. Nulls stay null; see ``find_private`` for
    the rest.
    """
    h, d, t = new_name(docs, "_hash"), new_name(docs, "_doc"), new_name(docs, "_terms")
    found = find_private(docs, id_col=id_col, text_col=text_col, **options).distinct().select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.array_sort(F.concat("base", "terms")).alias(t))
    text = F.col(text_col)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        tag = F.when((s["rank"] == KINDS.index("term")) & (s["value"] == "remove"), "").otherwise(F.get(tags, s["rank"]))
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), tag)
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), fresh.alias("out"))).otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(F.col(t), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    joined = docs.withColumn(h + "0", F.xxhash64(text)).join(found, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(h + "0") == F.col(h)), "left")
    return joined.select(*[F.when(F.size(t) > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
