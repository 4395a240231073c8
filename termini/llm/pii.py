"""Personal data: exact base patterns, and terms that reveal them, judged by corpus co-occurrence.

Built-in functions only. Base matches (email, ip, card, phone) are protected entities. For each entity c and each term t
of a document with c, the corpus gives n(c), n(t) (documents with them) and n(t,c) (documents with both). The share of the
entity's information that the term discloses is

    PMI(t;c) / IC(c) = log2(N n(t,c) / (n(t) n(c))) / log2(N / n(c))

A term that reaches GENERALISE is generalised, one that reaches REMOVE is removed, everywhere in the documents with the
entity, however few they are. In a document without the entity a term is generalised if it reaches REMOVE with n(t,c) - 1 in
place of n(t,c): one document in which both stand is no evidence about another one. An entity of all documents carries no
information, so nothing discloses it.

A term is generalised to a broader one that the corpus gives: of the terms that disclose none of a document's entities, the
rarest is the document's own; a term takes the rarest of these from the documents that it shares with the entity. It is
always more frequent than the term. Where no document has one, the tag [TERM] stands instead. Base matches count as white
space when terms are read.

Nulls, empty texts and empty tables: a null text is empty; an empty text has no span; no rows give no rows. Repeated rows
each get the same result. Rows are told apart by doc_id (null is an id too) and text. Extra columns are ignored by
find_pii and kept by sanitise, which uses internal names with the prefix __pii_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, same, stored, unused, whole_text

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")
GENERALISE, REMOVE, BLOCK, SALTS = 0.85, 0.95, 128, 16

# Possessive forms of the contract's patterns: they match the same spans without backtracking over long runs. A match can
# only begin where a run of its class begins, or where the last match ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, kind: int, pattern: str, gate: Column) -> Column:
    """Spans (code points) of all matches in order: what lies between matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    end = lambda acc, x: start(acc, x) + F.length(x["hit"])
    found = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            end(acc, x).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(start(acc, x).alias("start"), F.lit(kind).alias("kind"), end(acc, x).alias("end"), x["hit"].alias("value")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(gate, found).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of text by start, then kind."""
    email = _matches(text, 0, EMAIL, text.contains("@"))
    ip = F.filter(_matches(text, 1, IP, text.rlike(IP)), lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    card = _matches(text, 2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.filter(card, lambda s: F.when(F.length(_digits(s["value"])).between(14, 19), _luhn(_digits(s["value"]))).otherwise(False))
    phone = F.filter(_matches(text, 3, PHONE, text.contains("+")), lambda s: F.length(_digits(s["value"])).between(10, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _blanked(text: Column, spans: Column) -> Column:
    """text with white space in place of each span, as long as before."""
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["end"] > acc["at"],
                F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.repeat(F.lit(" "), s["end"] - F.greatest(acc["at"], s["start"])))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def _words(text: Column, spans: Column) -> Column:
    """The terms of text beside its base spans, in lower case, as often as they stand there."""
    return F.regexp_extract_all(F.lower(_blanked(text, spans)), F.lit(TERM), F.lit(0))


def _terms(text: Column, spans: Column) -> Column:
    """The distinct terms of text (hashes)."""
    return F.array_distinct(F.transform(_words(text, spans), lambda w: F.xxhash64(w)))


def _term_spans(text: Column, spans: Column, verdicts: Column) -> Column:
    """The spans of the terms of verdicts (array of term, a hash, and word, the broader term or null for a term to remove);
    a generalised span's value is its broader term. Places are summed in blocks of BLOCK terms, then over
    the blocks, since an array that grows term by term would cost the square of a long text's terms."""
    kept = _blanked(text, spans)
    judged = verdicts["term"]
    let = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))

    def of(pairs: Column) -> Column:
        count = F.ceil(F.size(pairs) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        blocks = F.when(count > 0, blocks).otherwise(F.array().cast("array<array<struct<gap:int,n:int,term:bigint>>>"))
        return let(blocks, placed)

    def placed(blocks: Column) -> Column:
        size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        begin = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + size(x))))
        return let(begin, lambda first: F.flatten(F.transform(blocks, lambda block, k: inside(block, F.get(first, k)))))

    def inside(block: Column, first: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(first.alias("at"), F.array().cast(SPAN).alias("spans")),
            lambda acc, x: let(
                F.array_position(judged, x["term"]).cast("int"),
                lambda at: F.struct(
                    (acc["at"] + x["gap"] + x["n"]).alias("at"),
                    F.when(
                        at > 0,
                        F.concat(acc["spans"], F.array(let(F.get(verdicts, at - 1)["word"], lambda word: F.struct((acc["at"] + x["gap"]).alias("start"), F.when(word.isNull(), 5).otherwise(4).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end"), word.alias("value"))))),
                    ).otherwise(acc["spans"]).alias("spans"),
                ),
            ),
            lambda acc: acc["spans"],
        )

    hits = F.regexp_extract_all(kept, F.lit(TERM), F.lit(0))
    pairs = F.zip_with(hits, F.split(kept, TERM, -1), lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), F.xxhash64(F.lower(hit)).alias("term")))
    return let(F.filter(pairs, lambda x: x["n"].isNotNull()), of)


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.xxhash64(s["kind"], F.when(s["kind"] < 2, F.lower(s["value"])).otherwise(_digits(s["value"])))))


def _verdicts(judged: DataFrame) -> DataFrame:
    """doc_id, __pii_key and `verdicts` from rows (doc_id, __pii_key, term, remove, broader) of terms to replace. Of several
    verdicts on a term the stricter holds, of several broader terms the most frequent."""
    one = judged.groupBy("doc_id", "__pii_key", "term").agg(F.max("remove").alias("remove"), F.max("broader").alias("broader"))
    word = F.when(~F.col("remove"), F.coalesce("broader.word", F.lit(TAGS[4])))
    return one.groupBy("doc_id", "__pii_key").agg(F.collect_list(F.struct("term", word.alias("word"))).alias("verdicts"))


def find_pii(documents: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """Two frames, for documents with base spans and for those without: doc_id, __pii_key (a hash of the text) and verdicts
    (array of term, a hash, and word: its broader term, null where it is removed), a row for each doc_id and text that holds
    a disclosing term. Base spans come from base_spans() and need no row here."""
    docs = documents.select("doc_id", whole_text().alias("text"))
    total = docs.count()
    none = F.array().cast(SPAN)
    docs = docs.withColumn("spans", F.when(F.col("text").rlike("[@0-9]"), base_spans(F.col("text"))).otherwise(none))
    # __pii_doc numbers the rows with an entity; it is stored, so it stays what it is
    seen = docs.where(F.size("spans") > 0).select(F.monotonically_increasing_id().alias("__pii_doc"), "doc_id", F.xxhash64("text").alias("__pii_key"), _entities(F.col("spans")).alias("entities"), F.array_distinct(_words(F.col("text"), F.col("spans"))).alias("words"))
    seen = stored(seen, "pii-seen")

    n = F.lit(float(max(total, 1)))
    # n(t,c) is at most n(c), so a term of more documents than this cannot reach the threshold: no verdict changes
    most = lambda n_entity: n * F.pow(n_entity / n, F.lit(float(generalise))) * (1 + 1e-9)
    entity = stored(seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < n), "pii-entities")
    term = docs.select(F.explode(_terms(F.col("text"), F.col("spans"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    held = seen.select("__pii_doc", F.explode("words").alias("word")).withColumn("term", F.xxhash64("word")).join(term, "term")
    held = stored(held, "pii-terms")
    named = stored(seen.select("__pii_doc", F.explode("entities").alias("entity")).join(entity, "entity"), "pii-named")

    # each document's rarest term that discloses none of its entities
    widest = named.groupBy("__pii_doc").agg(F.max("n_entity").alias("widest"))
    safe = held.join(widest, "__pii_doc").where(F.col("n_term") > most(F.col("widest")))
    own = safe.groupBy("__pii_doc").agg(F.min(F.struct("n_term", "word")).alias("broader"))
    pair = held.join(named.join(own, "__pii_doc", "left"), "__pii_doc").where(F.col("n_term") <= most(F.col("n_entity")))
    pair = stored(pair.select("__pii_doc", "term", "n_term", "entity", "n_entity", "broader"), "pii-pairs")

    disclosed = lambda both: F.log2(n * both / (F.col("n_term") * F.col("n_entity"))) / F.log2(n / F.col("n_entity"))
    rules = pair.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"), F.min("broader").alias("broader"))
    rules = rules.withColumns({"here": disclosed(F.col("n_both")), "elsewhere": F.when(F.col("n_both") > 1, disclosed(F.col("n_both") - 1))}).where(F.col("here") >= generalise)
    rules = stored(rules.select("entity", "term", "here", "elsewhere", "broader"), "pii-rules")

    # a rule meets all documents with its entity and term, so both sides are salted
    salted = rules.select("entity", "term", (F.col("here") >= remove).alias("remove"), "broader", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    flagged = pair.select("__pii_doc", "entity", "term", F.pmod("__pii_doc", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["entity", "term", "salt"])
    inside = flagged.join(seen.select("__pii_doc", "doc_id", "__pii_key"), "__pii_doc").select("doc_id", "__pii_key", "term", "remove", "broader")

    everywhere = rules.where(F.col("elsewhere") >= remove).groupBy("term").agg(F.lit(False).alias("remove"), F.max("broader").alias("broader"))
    everywhere = stored(everywhere, "pii-everywhere")
    elsewhere = docs.where(F.size("spans") == 0).select("doc_id", F.xxhash64("text").alias("__pii_key"), F.explode(_terms(F.col("text"), F.col("spans"))).alias("term"))
    elsewhere = elsewhere.join(everywhere, "term").select(*inside.columns)
    others = held.join(everywhere, "term").join(seen.select("__pii_doc", "doc_id", "__pii_key"), "__pii_doc").select(*inside.columns)
    # stored, so that their size is known before a join is chosen: most often no text is shuffled
    return stored(_verdicts(inside.unionByName(others)), "pii-inside"), stored(_verdicts(elsewhere), "pii-elsewhere")


def with_spans(documents: DataFrame, **thresholds: float) -> DataFrame:
    """documents (doc_id, text, others) with `__pii_base` and `__pii_spans`, all spans by start, then kind. Only documents
    with an entity, and their verdicts, meet in one join, and the others with theirs, which are few, in another."""
    docs = documents.withColumn("__pii_base", base_spans(whole_text()))
    holds = F.size("__pii_base") > 0
    parts = []
    for part, found in zip((docs.where(holds), docs.where(~holds)), find_pii(documents, **thresholds), strict=True):
        found = found.select(F.col("doc_id").alias("__pii_id"), F.col("__pii_key").alias("__pii_hash"), F.col("verdicts").alias("__pii_verdicts"))
        joined = part.withColumn("__pii_text_key", F.xxhash64(whole_text())).join(found, same(F.col("doc_id"), F.col("__pii_id")) & (F.col("__pii_text_key") == F.col("__pii_hash")), "left")
        terms = F.when(F.col("__pii_hash").isNotNull(), _term_spans(whole_text(), F.col("__pii_base"), F.col("__pii_verdicts"))).otherwise(F.array().cast(SPAN))
        parts.append(joined.withColumn("__pii_spans", F.sort_array(F.concat("__pii_base", terms))).drop("__pii_id", "__pii_hash", "__pii_verdicts", "__pii_text_key"))
    return parts[0].unionByName(parts[1])


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind's tag, a generalised one by its broader term; of overlapping spans the first
    counts."""
    tags = F.array(*map(F.lit, TAGS))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["kind"] == 4, s["value"]).otherwise(F.get(tags, s["kind"]))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )


def sanitise(documents: DataFrame, **thresholds: float) -> DataFrame:
    """documents with personal data and disclosing terms replaced in text; n_chars, where there, follows. A null text stays
    null, and a document without a span stays as it is. Extra columns may have any names."""
    aside = {c: unused(documents, f"__aside_{k}") for k, c in enumerate(documents.columns) if c.lower().startswith("__pii")}
    rows = with_spans(documents.withColumnsRenamed(aside), **thresholds)
    changed = F.size("__pii_spans") > 0
    out = rows.withColumn("text", F.when(changed, redacted(F.col("text"), F.col("__pii_spans"))).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[column(aside.get(c, c)).alias(c) for c in documents.columns])


def op1(documents: DataFrame) -> DataFrame:
    rows = with_spans(documents.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__pii_base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(written(F.col("__pii_base")), 256).alias("base_sha256"), written(F.col("__pii_spans")).alias("spans"))
