"""Personal data: patterns for known forms, and bootstrapped contexts for unseen ones.

Base spans (e-mail, IP, card, phone) are seeds, and so are secrets of well-known forms (access keys,
values assigned to a password or token). Each seed induces lexical patterns from the words around
it and the shape of its value; the other identifier-like strings of the corpus are the candidates.
Patterns and values form a graph, and Spark scores it in rounds: a pattern is as good as the share
of its distinct values that are known, a value as good as its best pattern. Values that patterns of
high confidence reach are known from then on, so they induce patterns in the next round; rounds end
when one finds nothing new. What is found becomes spans of the pattern's kind. DataFrame and SQL
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import discard_table, documents, free_name, written

#: In the order in which kinds are listed. Possessive repeats match what plain ones would and keep
#: long runs linear; a match starts where a run starts or the last match ended.
_MAIL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Forms of secrets: keys of known beginnings, and what is assigned to a name of a secret.
_NAMES = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
SECRET = rf"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}+|gh[opsur]_[A-Za-z0-9]{{30,}}+|sk_live_[A-Za-z0-9]{{16,}}+)|(?<={_NAMES}[\x22\x27]{{0,1}} {{0,1}}[:=] {{0,1}}[\x22\x27]{{0,1}})(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{{8,}}+"
SEEDS = {**BASE, "secret": SECRET}
KINDS = list(SEEDS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_OWN = "A-Za-z0-9._%+@#/-"
#: Stands where seeds were, so that candidates neither overlap nor touch them.
_GONE = r"\x01"
CANDIDATE = rf"(?:(?<![{_GONE}{_OWN}])|\G)[A-Za-z._%+#/-]*+[0-9@][{_OWN}]*+(?!{_GONE})"
#: Candidates of digit groups with spaces or brackets between them.
WIDE = rf"(?:(?<![{_GONE}{_OWN}])|\G)[(+]*+[0-9]++(?:(?:[)] ?|[ ./-][(]?|[(])[0-9]++)++(?![{_GONE}{_OWN}])"

#: Known values a pattern needs; confidence a value needs; values counted against each pattern.
SUPPORT, CONFIDENCE, DOUBT = 5, 0.8, 1.0
#: Matches that are gathered at a time: time grows with the square of this, not of a text's matches.
BLOCK = 64


def _valid(kind: str, m: str) -> str:
    """SQL: whether match ``m`` passes the kind's check."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        return f"{m} rlike '^{_PART}(?:[.]{_PART}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "card":
        # digits from the right; every second one doubled, less 9 above 9
        luhn = f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 1, int(c) * 2 - if(int(c) > 4, 9, 0), int(c))), 0, (a, x) -> a + x) % 10 = 0"
        return f"CASE WHEN length({digits}) between 12 and 19 THEN {luhn} ELSE false END"
    if kind == "candidate":
        return f"length({m}) >= 7 and (length({digits}) >= 4 or instr({m}, '@') > 0)"
    return "true"


_SPANS = "array<struct<s: int, k: int, e: int, kind: string, v: string>>"


def spans(kind: str, pattern: str, text: str = "text") -> Column:
    """array<struct<s, k, e, kind, v>>: the valid matches in ``text``; s and e count code points."""
    p, none = pattern.replace("\\", "\\\\"), f"cast(array() AS {_SPANS})"
    place = KINDS.index(kind) if kind in KINDS else 9
    one = f"struct(a.at + length(z.g) AS s, {place} AS k, a.at + length(z.g) + length(z.m) AS e, '{kind}' AS kind, z.m AS v)"
    block = (
        f"aggregate(slice(zz, n * {BLOCK} + 1, {BLOCK}), struct(acc.at AS at, {none} AS o), (a, z) -> struct(a.at + length(z.g) + coalesce(length(z.m), 0) AS at, "
        f"CASE WHEN z.m IS NOT NULL AND {_valid(kind, 'z.m')} THEN concat(a.o, array({one})) ELSE a.o END AS o))"
    )
    whole = f"aggregate(sequence(0, (size(zz) - 1) div {BLOCK}), struct(0 AS at, {none} AS o), (acc, n) -> aggregate(array({block}), acc, (p, q) -> struct(q.at AS at, concat(p.o, q.o) AS o)), r -> r.o)"
    # the matches and the gaps before them, looked up once
    step = f"element_at(transform(array(zip_with(regexp_extract_all({text}, '{p}', 0), split({text}, '{p}', -1), (m, g) -> struct(m AS m, g AS g))), zz -> {whole}), 1)"
    # texts that lack what every match has are not scanned
    need = {
        "email": "instr({0}, '@') > 0", "ip": "{0} rlike '[0-9][.][0-9]'", "card": "{0} rlike '[0-9]{{4}}|[0-9][ -][0-9]'", "phone": "instr({0}, '+') > 0", "candidate": "{0} rlike '[0-9@]'",
        "secret": "{0} rlike 'AKIA|ASIA|gh[opsur]_|sk_live_|(?i:passw|pwd|secret|token|key)'",
    }
    return F.expr(f"if({need[kind].format(text)}, {step}, {none})")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (sorted seed spans), near (candidates outside them), each with the words around it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[spans(k, p).alias(k) for k, p in SEEDS.items()])
    rows = rows.select("doc_id", "text", F.sort_array(F.concat(*KINDS)).alias("b"))
    # the text with seeds blanked out, in pieces that end with a seed: of overlapping ones the first counts whole
    reach = f"aggregate(b, struct(0 AS at, cast(array() AS array<struct<s: int, e: int>>) AS o), (a, x) -> struct(greatest(a.at, x.e) AS at, IF(x.e > a.at, concat(a.o, array(struct(greatest(a.at, x.s) AS s, x.e AS e))), a.o) AS o), a -> a.o)"
    rows = rows.withColumn("u", F.expr(f"if(size(b) > 0, {reach}, cast(array() AS array<struct<s: int, e: int>>))"))
    blank = "array_join(concat(transform(u, (x, i) -> concat(substring(text, IF(i = 0, 0, u[i - 1].e) + 1, x.s - IF(i = 0, 0, u[i - 1].e)), repeat('\\u0001', x.e - x.s))), array(substring(text, u[size(u) - 1].e + 1))), '')"
    rows = rows.withColumn("rest", F.expr(f"if(size(u) > 0, {blank}, text)"))
    rows = rows.select("doc_id", "text", "b", F.array_union(spans("candidate", CANDIDATE, "rest"), spans("candidate", WIDE, "rest")).alias("c"))
    edge = r"\\s\\x22\\x27\\x7B\\x7D\\x5B\\x5D()<>=:,;"
    around = (
        "transform({0}, x -> struct(x.s AS s, x.k AS k, x.e AS e, x.kind AS kind, x.v AS v, "
        f"lower(regexp_extract(substring(text, greatest(1, x.s - 39), least(40, x.s)), '([^{edge}]{{{{1,30}}}})[{edge}]+$', 1)) AS l, "
        f"lower(regexp_extract(substring(text, x.e + 1, 40), '^[.{edge}]+([^{edge}]{{{{1,30}}}})', 1)) AS r))"
    )
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(around.format("b")).alias("base"), F.expr(around.format("c")).alias("near"))


def _edges(table: DataFrame) -> DataFrame:
    """(pattern, value, kind): distinct links of the graph; kind is null for unseen values."""
    # letters and digits that alternate say no more than that they do
    mixed = F.regexp_replace("o.v", "(?:[A-Za-z]+[0-9]+){2}[A-Za-z0-9]*|(?:[0-9]+[A-Za-z]+){2}[A-Za-z0-9]*", "9a9")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "9"), "[A-Za-z]+", "a"), "(?:[.]a)+", ".a")
    both = table.select(F.explode(F.concat("base", "near")).alias("o")).select(F.col("o.v").alias("value"), F.when(F.col("o.kind") != "candidate", F.col("o.kind")).alias("kind"), "o.l", "o.r", shape.alias("shape"))
    kinds = F.array(
        F.when(F.length("l") > 0, F.concat_ws(" ", F.lit("L"), "l", "shape")), F.when(F.length("r") > 0, F.concat_ws(" ", F.lit("R"), "r", "shape")),
        F.when((F.length("l") > 0) & (F.length("r") > 0), F.concat_ws(" ", F.lit("B"), "l", "r")),
    )
    return both.select(F.explode(kinds).alias("pattern"), "value", "kind").where("pattern is not null").distinct()


def learned(table: DataFrame) -> DataFrame:
    """(value, new_kind) of unseen values that patterns of high confidence reach."""
    edges = written(_edges(table), "edges")
    known = written(edges.where("kind is not null").select("value", "kind").distinct(), "seeds")
    seeds = known
    # patterns of too few values can never count: they leave the graph
    large = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= SUPPORT)
    graph = written(edges.select("pattern", "value").distinct().join(written(large, "large"), "pattern"), "graph")
    discard_table(edges)
    while True:  # every round knows more values than the last, of a finite number
        good = graph.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("good"), F.first("n").alias("n")).where(F.col("good") >= SUPPORT)
        confident = written(good.where(F.col("good") / (F.col("n") + DOUBT) >= CONFIDENCE).withColumn("c", F.col("good") / (F.col("n") + DOUBT)), "patterns")
        reach = graph.join(confident.select("pattern", "kind", "c"), "pattern").groupBy("value").agg(F.max(F.struct("c", "kind")).alias("m"))
        fresh = written(reach.join(known.select("value"), "value", "left_anti").select("value", F.col("m.kind").alias("kind")), "fresh")
        if fresh.isEmpty():
            break
        known = written(known.unionByName(fresh), "known")
    return known.join(seeds.select("value"), "value", "left_anti").select("value", F.col("kind").alias("new_kind"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and all_spans (array<struct<s, k, e>>) for every row of ``docs``.

    k is the kind's place in KINDS; base holds all seeds, secrets too; spans are sorted by start,
    then kind. A null text is an empty one without spans. Rows with a null or repeated id are each returned. Other columns are
    ignored. An empty table gives no rows and nothing is learned.
    """
    table = written(found(docs), "found")
    values = learned(table)
    index = F.expr("CASE new_kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END").cast("int")
    near = table.where(F.size("near") > 0).select("doc_id", "text_hash", F.explode("near").alias("o")).distinct()
    more = near.join(values, F.col("o.v") == F.col("value")).select("doc_id", "text_hash", F.struct(F.col("o.s").alias("s"), index.alias("k"), F.col("o.e").alias("e")).alias("x"))
    more = more.groupBy("doc_id", "text_hash").agg(F.collect_set("x").alias("more")).withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    plain = F.transform("base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e")))
    met = table.select("doc_id", "text_hash", plain.alias("base")).join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    return met.select("doc_id", "text_hash", "base", F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() AS array<struct<s: int, k: int, e: int>>)")))).alias("all_spans"))


def told(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.expr(f"transform({column}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e))"), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become the first one's kind.

    Keeps all columns and rows; n_chars, if there is one, counts the new text. Null texts stay null.
    """
    id_, hash_, spans_ = (free_name(docs, n) for n in ("__id", "__hash", "__spans"))
    found = personal_spans(docs).where(F.size("all_spans") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("all_spans").alias(spans_)).dropDuplicates([id_, hash_])
    met = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hash_)), "left")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    new = F.expr(
        f"if({spans_} IS NULL, text, aggregate({spans_}, struct(0 AS at, '' AS o), (a, x) -> if(x.s >= a.at, "
        f"struct(x.e AS at, concat(a.o, substring(text, a.at + 1, x.s - a.at), element_at({names}, x.k + 1)) AS o), struct(greatest(a.at, x.e) AS at, a.o AS o)), "
        "a -> concat(a.o, substring(text, a.at + 1))))"
    )
    kind = dict(docs.dtypes).get("n_chars")
    out = met.withColumn("text", new)
    return (out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; counts and digest of base spans, and all spans, with their number."""
    rows = personal_spans(documents(spark, sf_dir)).withColumn("base", F.expr(f"filter(base, x -> x.k < {len(BASE)})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.size("all_spans").cast("long").alias("n_spans"), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("all_spans").alias("spans"))
