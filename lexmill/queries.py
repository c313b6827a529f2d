"""The registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.hashing import HashingConfig, char_ngrams, portable_vector, vectorize, word_ngrams
from lexmill.operators import classifiers as C
from lexmill.operators import extraction as X
from lexmill.operators import schema as S
from lexmill.operators import store, tagging, vocabulary
from lexmill.plans.engine import Engine
from lexmill.plans.logwatch import findings, scan, train
from lexmill.plans.routing import extract_by_label
from lexmill.sources.models import NAIVE_BAYES, header_lines, observation_lines

BUCKETS = 1024
HASHING = HashingConfig(1, 2)
KEY = bytes(range(32))


def spread(df: DataFrame) -> DataFrame:
    """Deals out an input that comes in fewer partitions than there are cores (one small file, say), so that
    the work per row isn't done by one task.  Larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "orders", "events") else df


# -- inputs that several queries share ----------------------------------------------------------
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement line for each order: (row_id, kind, text), in three layouts."""
    o = table(spark, sf_dir, "orders")
    day, amount = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    number = F.concat(F.lit("AB"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "invoice").when(F.col("o_orderstatus") == "O", "order").otherwise("notice")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat_ws(" ", F.lit("Invoice ClientRef:"), number, day, F.lit("total"), amount, F.lit("tax"), F.lit("12,50")))
        .when(F.col("o_orderstatus") == "O", F.concat_ws(" ", F.lit("Order Acme-Leben"), amount, F.lit("Borea-Kfz 120.00 on"), day, F.lit("-->"), "o_orderpriority"))
        .otherwise(F.concat_ws(" ", F.lit("Notice"), day, F.lit("for"), number, F.lit("total"), amount))
    )
    return o.select(F.col("o_orderkey").alias("row_id"), kind.alias("kind"), text.alias("text"))


STATEMENTS = """
s AS (SELECT o_orderkey AS row_id,
  CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'order' ELSE 'notice' END AS kind,
  CASE o_orderstatus
    WHEN 'F' THEN concat_ws(' ', 'Invoice ClientRef:', 'AB' || o_custkey, strftime(o_orderdate, '%Y-%m-%d'), 'total', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 'tax', '12,50')
    WHEN 'O' THEN concat_ws(' ', 'Order Acme-Leben', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 'Borea-Kfz 120.00 on', strftime(o_orderdate, '%Y-%m-%d'), '-->', o_orderpriority)
    ELSE concat_ws(' ', 'Notice', strftime(o_orderdate, '%Y-%m-%d'), 'for', 'AB' || o_custkey, 'total', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)) END AS text
  FROM orders)"""

SP = r"\x09-\x0D\x1C-\x1F\p{Z}"
DE = (r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}", r"\d{1,3}(\.\d{3})*,\d{2}|\d+,\d{2}|\d+\.\d{2}", r"\d+([.,]\d{3})*")
EN = (r"\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}", r"\d{1,3}(,\d{3})*\.\d{2}|\d+\.\d{2}", r"\d+(,\d{3})*")


def sql_type(t: str, rules=DE, custom: str = "") -> str:
    date, amount, number = rules
    return (
        f"CASE {custom} WHEN regexp_full_match({t}, '{date}') THEN 'DATE' WHEN regexp_full_match({t}, '{amount}') THEN 'AMOUNT' WHEN regexp_full_match({t}, '{number}') THEN 'NUMERIC' "
        rf"WHEN regexp_full_match({t}, '\p{{L}}+') THEN 'WORD' WHEN regexp_full_match({t}, '[\p{{L}}\d]+') THEN 'ALPHANUMERIC' WHEN regexp_full_match({t}, '[^\p{{L}}\d\t\n\x0B\f\r ]+') THEN 'SYMBOL' ELSE 'WORD_SYMBOL' END"
    )


def sql_tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '[^{SP}]+')"


def sql_normal(t: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({t}, '[\x00-\x20\x7F]+', ' ', 'g'), '^[{SP}]+|[{SP}]+$', '', 'g'))"


CODE = "CASE t WHEN 'WORD' THEN 'W' WHEN 'NUMERIC' THEN 'N' WHEN 'ALPHANUMERIC' THEN 'A' WHEN 'DATE' THEN 'D' WHEN 'AMOUNT' THEN 'M' WHEN 'SYMBOL' THEN 'S' ELSE 'X' END"
#: token rows of the statement lines: row_id, kind, pos, tok, t (type), c (code), start, stop
STATEMENT_TOKENS = f"""{STATEMENTS},
pieces AS (SELECT row_id, kind, text, unnest(regexp_extract_all(text, '[{SP}]+|[^{SP}]+')) AS p, generate_subscripts(regexp_extract_all(text, '[{SP}]+|[^{SP}]+'), 1) AS k FROM s),
ends AS (SELECT *, sum(length(p)) OVER (PARTITION BY row_id ORDER BY k) AS stop FROM pieces),
typed AS (SELECT row_id, kind, row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS pos, p AS tok, CAST(stop - length(p) AS INT) AS start, CAST(stop AS INT) AS stop, {sql_type('p')} AS t FROM ends WHERE regexp_matches(p, '[^{SP}]')),
tokens AS (SELECT *, {CODE} AS c FROM typed)"""


def portable_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled documents with MD5 word features."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.array_remove(F.split(T.normalize(F.coalesce("text", F.lit(""))), " "), "")
    named = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.min(F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("label"))
    joined = d.join(named, F.col("doc_id") == F.col("l_id"), "left")
    # the label is known before a text is read, so each document is vectorized once: to learn from it, or to score it
    known, pool = (joined.filter(f).select("doc_id", "label", portable_vector(words, BUCKETS).alias("v")) for f in ("label is not null", "label is null"))
    columns = F.col("doc_id").alias("row_id"), F.col("doc_id").alias("seq"), "label", "v.indices", "v.values"
    return known.select(*columns), pool.select(*columns)


PORTABLE = f"""
w AS (SELECT doc_id, unnest(string_split({sql_normal("coalesce(text, '')")}, ' ')) AS w FROM documents),
e AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {BUCKETS} AS idx, count(*)::DOUBLE AS v FROM w WHERE w <> '' GROUP BY ALL),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END) AS label FROM labels GROUP BY doc_id),
obs AS (SELECT d.doc_id, lab.label FROM documents d JOIN lab USING (doc_id)),
cnt AS (SELECT label, idx, sum(v) AS total FROM obs JOIN e USING (doc_id) GROUP BY ALL),
docs AS (SELECT label, count(*) AS docs FROM obs GROUP BY ALL),
mass AS (SELECT label, sum(total) AS mass FROM cnt GROUP BY ALL),
facts AS (SELECT label, docs, coalesce(mass, 0) AS mass, (SELECT greatest(count(DISTINCT idx), 1) FROM cnt) AS V, (SELECT sum(docs) FROM docs) AS N FROM docs LEFT JOIN mass USING (label))"""
SCORED = f"""{PORTABLE},
pool AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lab)),
tot AS (SELECT doc_id, sum(v) AS tv FROM e GROUP BY ALL),
gain AS (SELECT e.doc_id, cnt.label, sum(v * ln(total + 1)) AS gain FROM e JOIN cnt USING (idx) GROUP BY ALL),
sc AS (SELECT p.doc_id, f.label, ln(docs / N) - coalesce(tv, 0) * ln(mass + V) + coalesce(gain, 0) AS score
  FROM pool p CROSS JOIN facts f LEFT JOIN tot USING (doc_id) LEFT JOIN gain g ON g.doc_id = p.doc_id AND g.label = f.label),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS x FROM sc),
pr AS (SELECT doc_id, label, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) AS place FROM pr)"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, pool = portable_observations(spark, sf_dir)
    return C.score_dense(pool, C.naive_bayes_weights(C.fit_naive_bayes(known)))


# -- text --------------------------------------------------------------------------------------
def normalize_text(spark, sf_dir):
    n = T.normalize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("chars"))


def _type_counts(tokens: Column, df: DataFrame, rules=T.GERMAN) -> DataFrame:
    return df.select(F.explode(tokens).alias("tok")).groupBy(T.token_type(F.col("tok"), rules).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def tokenize_whitespace_type_counts(spark, sf_dir):
    return _type_counts(T.raw_tokens(F.col("text")), table(spark, sf_dir, "documents"))


def tokenize_offsets(spark, sf_dir):
    t = T.tokenize(F.coalesce("text", F.lit("")))
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(t).alias("t"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("t.start").cast("long")).alias("starts"), F.sum(F.col("t.end").cast("long")).alias("ends"), F.sum(F.col("t.pos") * F.col("t.start").cast("long")).alias("weighted"))


def _us_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat_ws(" ", F.lit("paid"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.format_number("o_totalprice", 2), F.lit("id"), F.format_number("o_orderkey", 0)).alias("text"))


def tokenize_us_locale(spark, sf_dir):
    return _type_counts(T.raw_tokens(F.col("text")), _us_lines(spark, sf_dir), T.US)


CUSTOM = r"\d-[A-Z]+"


def tokenize_custom_rule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.lit("priority"), "o_orderpriority").alias("text"))
    return _type_counts(T.raw_tokens(F.col("text")), o, T.GERMAN.first((CUSTOM, T.ALPHANUMERIC)))


def tokenize_punct_aware(spark, sf_dir):
    each = statement_lines(spark, sf_dir).select("row_id", F.explode(T.tokenize_punctuation(F.col("text"))).alias("t"))
    return each.select("row_id", "t.pos", "t.text", "t.type", "t.start", "t.end")


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def pattern_signature(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(T.signature(T.token_types(F.col("line")))).alias("signature"))


def template_clusters(spark, sf_dir):
    return X.template_clusters(statement_lines(spark, sf_dir), "row_id")


def template_members(spark, sf_dir):
    return X.with_signature(statement_lines(spark, sf_dir)).select("row_id", "signature")


# -- extraction --------------------------------------------------------------------------------
PATTERN = X.TokenPattern.of(T.WORD, (T.DATE, X.OPTIONAL), T.AMOUNT)
FULL = X.TokenPattern.of((T.WORD, X.MANY), (T.WORD_SYMBOL, X.OPTIONAL), (T.ALPHANUMERIC, X.ANY), T.DATE, T.WORD, T.AMOUNT, T.WORD, T.AMOUNT)


def _tokenized(spark, sf_dir):
    return statement_lines(spark, sf_dir).select("row_id", "kind", T.tokenize(F.col("text")).alias("tokens"))


def pattern_find_all(spark, sf_dir):
    m = _tokenized(spark, sf_dir).select("row_id", F.explode(X.find_all(F.col("tokens"), PATTERN)).alias("m"))
    return m.select("row_id", "m.first", "m.last")


def pattern_matches_fully(spark, sf_dir):
    s = statement_lines(spark, sf_dir)
    return s.select("row_id", X.matches_fully(T.token_types(F.col("text")), FULL).alias("full"))


def _fields(spark, sf_dir, *slots):
    f = _tokenized(spark, sf_dir).select("row_id", F.explode(X.extract(F.col("tokens"), list(slots))).alias("f"))
    return f.select("row_id", "f.name", "f.value", "f.start", "f.end", "f.group_index")


def slot_positional(spark, sf_dir):
    return _fields(spark, sf_dir, X.PositionalSlot("second", 1), X.PositionalSlot("eighth", 7), X.PositionalSlot("none", -1)).drop("group_index")


def slot_key_anchored(spark, sf_dir):
    return _fields(spark, sf_dir, X.KeyAnchoredSlot("customer", "clientref", T.ALPHANUMERIC), X.KeyAnchoredSlot("after_total", "total")).drop("group_index")


def slot_repeating_group(spark, sf_dir):
    return _fields(spark, sf_dir, X.RepeatingGroupSlot((("insurer", T.WORD_SYMBOL), ("amount", T.AMOUNT))))


# -- vocabulary --------------------------------------------------------------------------------
def _words(df, col="text"):
    return df.select(F.explode(F.array_remove(F.split(F.coalesce(F.col(col), F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).alias("word"))


def word_frequency(spark, sf_dir):
    return vocabulary.word_frequencies(_words(table(spark, sf_dir, "documents")), at_least=2)


def symspell_candidates(spark, sf_dir):
    vocab = vocabulary.word_frequencies(_words(table(spark, sf_dir, "benchmark")), at_least=2)
    asked = _words(table(spark, sf_dir, "conversations")).select(F.lower("word").alias("query"))
    return vocabulary.near_words(asked, vocab)


def broken_word_repair(spark, sf_dir):
    vocab = vocabulary.word_frequencies(_words(table(spark, sf_dir, "benchmark")))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"(\p{L}{3})(\p{L}{3,})", "$1 $2").alias("text"))
    return vocabulary.repair(b, vocab).select("item_id", "repaired")


# -- features ----------------------------------------------------------------------------------
def char_ngram_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(char_ngrams(T.normalize(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def word_ngram_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(word_ngrams(T.normalize(F.coalesce("text", F.lit(""))))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def vectorize_siphash(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", vectorize(F.coalesce("text", F.lit("")), HASHING).alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("doc_id", F.size("v.indices").cast("long").alias("buckets"), total.alias("total"), F.hash("v.indices").alias("mark"))


def vectorize_portable(spark, sf_dir):
    known, pool = portable_observations(spark, sf_dir)
    return C.explode_features(known.select("row_id", "indices", "values").union(pool.select("row_id", "indices", "values")), "row_id")


# -- schemas -----------------------------------------------------------------------------------
INFERRED = {"customer": "c_mktsegment", "orders": "o_orderstatus", "part": "p_brand"}


def schema_inference(spark, sf_dir):
    rows = []
    for name, label in INFERRED.items():
        df = table(spark, sf_dir, name)
        rows += [(name, k, f.name, f.kind, f.sensitivity) for k, f in enumerate(S.infer(df.select([df[c].cast("string").alias(c) for c in df.columns]), label).fields)]
    return spark.createDataFrame(rows, "relation string, position int, field string, kind string, sensitivity string")


EVENTS = S.RecordSchema.define().numeric("value").text("props").identifier("user").categorical("absent").label("event_type").build()


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string"))
    kind = F.when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    return e.select("event_id", value.alias("value"), F.col("props"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), kind.alias("event_type"), F.lit("x").alias("note"))


def schema_validate(spark, sf_dir):
    v = S.validate(_events(spark, sf_dir), EVENTS, ignore=("event_id",))
    return v.select("event_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def record_import(spark, sf_dir):
    got = S.import_records(_events(spark, sf_dir), EVENTS, keep=("event_id",))
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part(got.accepted, "accepted").union(part(got.rejected, "rejected")).union(part(got.warnings, "warnings"))


def record_map(spark, sf_dir):
    return S.map_records(_events(spark, sf_dir), EVENTS, keep=("event_id",))


# -- classification ----------------------------------------------------------------------------
def nb_train(spark, sf_dir):
    m = C.fit_naive_bayes(portable_observations(spark, sf_dir)[0])
    return m.counts.select("label", F.col("idx").cast("long").alias("idx"), F.round("total", 6).alias("total"))


def nb_predict(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("row_id", "prediction.label", F.round("prediction.confidence", 6).alias("confidence"))


def nb_predict_joined(spark, sf_dir):
    known, pool = portable_observations(spark, sf_dir)
    return C.score_joined(pool, C.fit_naive_bayes(known)).select("row_id", "prediction.label", F.round("prediction.confidence", 6).alias("confidence"))


def nb_incremental(spark, sf_dir):
    """Half the observations, then the other half: the same statistics."""
    known = portable_observations(spark, sf_dir)[0]
    first, second = known.filter("row_id % 2 = 0"), known.filter("row_id % 2 = 1")
    m = C.add_naive_bayes(C.fit_naive_bayes(first), second)
    return m.labels.select("label", F.col("docs").cast("long").alias("docs"), F.round("mass", 6).alias("mass"))


def nb_metrics(spark, sf_dir):
    return C.metrics(portable_observations(spark, sf_dir)[0])


def prediction_alternatives(spark, sf_dir):
    p = scored_documents(spark, sf_dir).select("row_id", F.posexplode("prediction.alternatives").alias("place", "a"))
    return p.select("row_id", F.col("place").cast("long").alias("place"), "a.label", F.round("a.probability", 6).alias("probability"))


def lr_sgd_train_predict(spark, sf_dir):
    known, pool = portable_observations(spark, sf_dir)
    w = C.fit_logistic(known.select("seq", "label", "indices", "values"), epochs=1, rate=0.05)
    return C.score_dense(pool, C.logistic_weights(w)).select("row_id", "prediction.label", F.round("prediction.confidence", 6).alias("confidence"))


def lr_score_fixed_weights(spark, sf_dir):
    known, pool = portable_observations(spark, sf_dir)
    names = spark.createDataFrame([("good", 0.25), ("poor", -0.25)], "label string, b double")
    weight = names.crossJoin(spark.range(-1, BUCKETS).select(F.col("id").cast("int").alias("idx")))
    weight = weight.select("label", "idx", F.when(F.col("idx") < 0, F.col("b")).otherwise((F.col("idx") % 7 - 3) * F.col("b") / 100).alias("weight"))
    return C.linear_scores(pool, weight).select("row_id", "label", (F.round("score", 6) + 0.0).alias("score"))


def _review(strategy):
    def query(spark, sf_dir):
        top = C.select_for_review(scored_documents(spark, sf_dir).withColumn("prediction", _rounded(F.col("prediction"))), 20, strategy)
        return top.select("row_id", F.round("uncertainty", 6).alias("uncertainty"), F.round("margin", 6).alias("margin"))

    return query


def _rounded(p: Column) -> Column:
    """Probabilities with six places, so that ties are ties for any engine."""
    return F.struct(p["label"].alias("label"), F.round(p["confidence"], 6).alias("confidence"), F.transform(p["alternatives"], lambda a: F.struct(a["label"].alias("label"), F.round(a["probability"], 6).alias("probability"))).alias("alternatives"))


def pool_sample_top_k(spark, sf_dir):
    pool = C.sample_pool(scored_documents(spark, sf_dir), 100, 20, seed=3)
    return C.select_for_review(pool, 20).select("row_id", "margin")


def feature_store_dedup(spark, sf_dir):
    known = portable_observations(spark, sf_dir)[0]
    twice = known.union(known.withColumn("seq", F.col("seq") + 1_000_000_000))
    return store.distinct_observations(twice).select("seq", "label", F.size("indices").cast("long").alias("buckets"))


def retrain_from_store(spark, sf_dir):
    known = portable_observations(spark, sf_dir)[0]
    twice = known.union(known.withColumn("seq", F.col("seq") + 1_000_000_000))
    m = C.fit_naive_bayes(store.distinct_observations(twice))
    return m.labels.select("label", F.col("docs").cast("long").alias("docs"), F.round("mass", 6).alias("mass"))


def codec_aes_roundtrip(spark, sf_dir):
    aes = store.AesGcm(KEY)
    known, pool = portable_observations(spark, sf_dir)
    rows = known.select("row_id", "indices", "values").union(pool.select("row_id", "indices", "values"))
    sent = rows.select("row_id", aes.encrypt(store.encode_vector(F.col("indices"), F.col("values"))).alias("x"))
    back = sent.select("row_id", F.octet_length("x").cast("long").alias("bytes"), store.decode_vector(aes.decrypt(F.col("x"))).alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("row_id", "bytes", F.size("v.indices").cast("long").alias("buckets"), F.aggregate("v.indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("indices"), total.alias("total"))


def crf_tagging(spark, sf_dir):
    tokens = _tokenized(spark, sf_dir).select("row_id", "tokens")
    tagged = tokens.select(F.col("row_id").alias("seq"), "tokens", F.transform("tokens", lambda t: F.when(t["type"] == T.AMOUNT, F.lit("VALUE")).when(t["type"] == T.DATE, F.lit("DAY")).otherwise(F.lit("OTHER"))).alias("tags"))
    # the training set: the first line of each distinct template
    first = X.template_clusters(statement_lines(spark, sf_dir), "row_id").select(F.col("first_id").alias("seq"))
    crf = tagging.load_crf(tagging.fit_crf(tagged.join(first, "seq"), epochs=40))
    return tokens.select("row_id", F.array_join(tagging.tag_tokens(F.col("tokens"), crf), " ").alias("tags"))


def model_export_text(spark, sf_dir):
    schema = S.RecordSchema.define().text("text").label("label").build()
    head = spark.createDataFrame([(k - 100, v) for k, v in enumerate(header_lines(schema, NAIVE_BAYES, HASHING))], "seq long, value string")
    return head.union(observation_lines(portable_observations(spark, sf_dir)[0])).select("seq", F.md5("value").alias("line"))


def csv_predict(spark, sf_dir):
    p = scored_documents(spark, sf_dir).select("row_id", _rounded(F.col("prediction")).alias("p"))
    return p.select("row_id", F.col("p.label").alias("label"), F.format_string("%.4f", F.round("p.confidence", 4)).alias("confidence"))


SLOTS = {
    "invoice": [X.KeyAnchoredSlot("customer", "ClientRef", T.ALPHANUMERIC), X.KeyAnchoredSlot("total", "total", T.AMOUNT)],
    "order": [X.RepeatingGroupSlot((("insurer", T.WORD_SYMBOL), ("amount", T.AMOUNT)))],
}


def classify_route_extract(spark, sf_dir):
    """The flagship: a classifier learned from all lines routes each of them to the slots of its label."""
    lines = statement_lines(spark, sf_dir)
    schema = S.RecordSchema.define().text("text").label("kind").build()
    engine = Engine(spark, schema, HASHING)
    engine.learn(lines)
    scored = engine.classify(lines)
    out = extract_by_label(scored, F.col("prediction.label"), "text", SLOTS)
    return out.select("row_id", F.col("prediction.label").alias("label"), F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "; ").alias("fields"))


def _log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 5 == 0, "ERROR").when(F.col("event_id") % 5 == 1, "WARN").when(F.col("event_id") % 5 == 2, "note").otherwise("INFO")
    message = F.when(F.col("event_id") % 5 == 0, "database connection refused").when(F.col("event_id") % 5 == 1, "request timed out after retry").otherwise("user request served")
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] app."), "event_type", F.lit(" - "), message).alias("value"))


RULES = [("DB_ERROR", "ERROR", "database connection refused"), ("DB_ERROR", "ERROR", "database query failed"), ("TIMEOUT", "WARN", "request timed out"), ("TIMEOUT", "WARN", "timed out after retry"), ("NORMAL", "INFO", "user request served"), ("NORMAL", "INFO", "request done")]


def log_parse(spark, sf_dir):
    from lexmill.sources.logs import parse_lines

    return parse_lines(_log_lines(spark, sf_dir)).select("event_id", "level", "message")


def log_watch(spark, sf_dir):
    engine = train(spark, spark.createDataFrame(RULES, "anomaly_type string, level string, message string"), HASHING)
    return findings(scan(engine, _log_lines(spark, sf_dir)), 0.5).select("event_id", "level", "anomaly_type")


_NAMES = """normalize_text tokenize_whitespace_type_counts tokenize_offsets tokenize_us_locale tokenize_custom_rule tokenize_punct_aware pattern_signature
template_clusters template_members pattern_find_all pattern_matches_fully slot_positional slot_key_anchored slot_repeating_group word_frequency symspell_candidates broken_word_repair
char_ngram_counts word_ngram_counts vectorize_siphash vectorize_portable schema_inference schema_validate record_import record_map nb_train nb_predict nb_predict_joined nb_incremental nb_metrics
prediction_alternatives lr_sgd_train_predict lr_score_fixed_weights pool_sample_top_k feature_store_dedup retrain_from_store codec_aes_roundtrip crf_tagging model_export_text csv_predict
classify_route_extract log_parse log_watch""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | {f"active_learning_{s.lower()}": _review(s) for s in C.STRATEGIES}


# -- SQL ---------------------------------------------------------------------------------------
def _inference_sql() -> str:
    columns = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
    parts = []
    for t, cs in columns.items():
        for k, c in enumerate(cs):
            if c == INFERRED[t]:
                parts.append(f"SELECT '{t}' AS relation, {k} AS position, '{c}' AS field, 'LABEL' AS kind")
                continue
            v = f"nullif(trim(CAST({c} AS VARCHAR)), '')"
            parts.append(
                f"SELECT '{t}' AS relation, {k} AS position, '{c}' AS field, CASE WHEN count({v}) > 0 AND bool_and(TRY_CAST({v} AS DOUBLE) IS NOT NULL) THEN 'NUMERIC' "
                f"WHEN count(DISTINCT {v}) BETWEEN 1 AND least(20, count({v}) - 1) THEN 'CATEGORICAL' "
                rf"WHEN count({v}) > 0 AND count(DISTINCT {v}) = count({v}) AND bool_and(length({v}) >= 4 AND regexp_full_match({v}, '[\p{{L}}\d]+') AND regexp_matches({v}, '\p{{Nd}}')) THEN 'IDENTIFIER' ELSE 'TEXT' END AS kind FROM {t}"
            )
    return f"SELECT relation, position, field, kind, CASE kind WHEN 'IDENTIFIER' THEN 'PII' ELSE 'PUBLIC' END AS sensitivity FROM ({' UNION ALL '.join(parts)})"


EVENT_ROWS = """ev AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) END AS value, props, 'U' || user_id AS usr,
  CASE WHEN event_id % 13 = 0 THEN '  ' ELSE event_type END AS event_type FROM events),
ch AS (SELECT event_id, value, props, event_type,
  concat_ws('; ', CASE WHEN trim(coalesce(event_type, '')) = '' THEN 'label ''event_type'' has no value' END, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL AND value IS NOT NULL THEN '''value'' is no number: ' || value END) AS errors,
  concat_ws('; ', CASE WHEN value IS NULL THEN '''value'' is not there' END, CASE WHEN props IS NULL THEN '''props'' is not there' END, CASE WHEN usr IS NULL THEN '''user'' is not there' END, '''absent'' is not there', '''note'' is no field of the schema') AS warnings FROM ev)"""
LEVEL = " ".join(f"WHEN list_contains(string_split_regex(upper(v), '[\\s\\[\\]:|]+'), '{x}') THEN '{x}'" for x in ("ERROR", "WARN", "INFO", "DEBUG", "TRACE"))
LOG_LINES = f"""lg AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE event_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'note' ELSE 'INFO' END || '] app.' || event_type || ' - ' ||
  CASE event_id % 5 WHEN 0 THEN 'database connection refused' WHEN 1 THEN 'request timed out after retry' ELSE 'user request served' END AS v FROM events),
pl AS (SELECT event_id, CASE {LEVEL} END AS level, trim(CASE WHEN instr(v, ' - ') > 0 THEN substr(v, instr(v, ' - ') + 3) ELSE v END) AS message FROM lg)"""


def _review_sql(measure: str) -> str:
    return f"""WITH {SCORED}, rp AS (SELECT doc_id, label, place, round(p, 6) AS p FROM rk),
      u AS (SELECT doc_id, max(p) FILTER (place = 1) - max(p) FILTER (place = 2) AS m, max(p) AS top, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h FROM rp GROUP BY doc_id)
      SELECT doc_id AS row_id, round({measure}, 6) AS uncertainty, round(m, 6) AS margin FROM u ORDER BY {measure} DESC, doc_id LIMIT 20"""


ORACLE = {
    "normalize_text": f"SELECT doc_id, md5({sql_normal("coalesce(text, '')")}) AS digest, length({sql_normal("coalesce(text, '')")}) AS chars FROM documents",
    "tokenize_whitespace_type_counts": f"SELECT {sql_type('tok')} AS type, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY 1",
    "tokenize_offsets": f"""WITH pieces AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{SP}]+|[^{SP}]+')) AS p, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[{SP}]+|[^{SP}]+'), 1) AS k FROM documents),
      ends AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM pieces),
      tok AS (SELECT *, stop - length(p) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM ends WHERE regexp_matches(p, '[^{SP}]'))
      SELECT doc_id, count(*) AS tokens, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends, CAST(sum(pos * start) AS BIGINT) AS weighted FROM tok GROUP BY doc_id""",
    "tokenize_us_locale": f"SELECT {sql_type('tok', EN)} AS type, count(*) AS n FROM (SELECT unnest({sql_tokens("concat_ws(' ', 'paid', strftime(o_orderdate, '%m/%d/%Y'), format('{:,.2f}', o_totalprice), 'id', format('{:,}', o_orderkey))")}) AS tok FROM orders) GROUP BY 1",
    "tokenize_custom_rule": f"SELECT {sql_type('tok', DE, f"WHEN regexp_full_match(tok, '{CUSTOM}') THEN 'ALPHANUMERIC'")} AS type, count(*) AS n FROM (SELECT unnest({sql_tokens("'priority ' || o_orderpriority")}) AS tok FROM orders) GROUP BY 1",
    "pattern_signature": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)
      SELECT doc_id, line_no, md5(coalesce(array_to_string(list_transform({sql_tokens('line')}, lambda x: '<' || lower({sql_type('x')}) || '>'), ' '), '')) AS signature FROM l""",
    "template_clusters": f"WITH {STATEMENTS} SELECT array_to_string(list_transform({sql_tokens('text')}, lambda x: '<' || lower({sql_type('x')}) || '>'), ' ') AS signature, count(*) AS size, min(row_id) AS first_id FROM s GROUP BY 1",
    "template_members": f"WITH {STATEMENTS} SELECT row_id, array_to_string(list_transform({sql_tokens('text')}, lambda x: '<' || lower({sql_type('x')}) || '>'), ' ') AS signature FROM s",
    "pattern_find_all": f"""WITH {STATEMENT_TOKENS}, enc AS (SELECT row_id, string_agg(c, '' ORDER BY pos) AS e FROM tokens GROUP BY row_id),
      seg AS (SELECT row_id, unnest(regexp_extract_all(e, 'WD?M|.')) AS g, generate_subscripts(regexp_extract_all(e, 'WD?M|.'), 1) AS k FROM enc),
      ranges AS (SELECT *, sum(length(g)) OVER (PARTITION BY row_id ORDER BY k) AS stop FROM seg)
      SELECT row_id, CAST(stop - length(g) AS INT) AS first, CAST(stop - 1 AS INT) AS last FROM ranges WHERE length(g) > 1""",
    "pattern_matches_fully": f"WITH {STATEMENT_TOKENS} SELECT row_id, regexp_full_match(string_agg(c, '' ORDER BY pos), 'W+X?A*DWMWM') AS full FROM tokens GROUP BY row_id",
    "slot_positional": f"""WITH {STATEMENT_TOKENS} SELECT row_id, CASE pos WHEN 1 THEN 'second' ELSE 'eighth' END AS name, tok AS value, start, stop AS "end" FROM tokens WHERE pos IN (1, 7)""",
    "slot_key_anchored": rf"""WITH {STATEMENT_TOKENS}, a AS (SELECT row_id, min(pos) FILTER (lower(regexp_replace(tok, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+$', '', 'g')) = 'clientref') AS k, min(pos) FILTER (lower(tok) = 'total') AS t FROM tokens GROUP BY row_id)
      SELECT * FROM (SELECT DISTINCT ON (row_id) row_id, 'customer' AS name, tok AS value, start, stop AS "end" FROM tokens JOIN a USING (row_id) WHERE pos > k AND t.t = 'ALPHANUMERIC' ORDER BY row_id, pos)
      UNION ALL SELECT row_id, 'after_total', tok, start, stop FROM tokens JOIN a USING (row_id) WHERE pos = a.t + 1""".replace("t.t =", "tokens.t ="),
    "slot_repeating_group": f"""WITH {STATEMENT_TOKENS}, p AS (SELECT *, lead(t) OVER w AS nt, lead(tok) OVER w AS ntok, lead(start) OVER w AS nstart, lead(stop) OVER w AS nstop FROM tokens WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
      g AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS INT) AS group_index FROM p WHERE t = 'WORD_SYMBOL' AND nt = 'AMOUNT')
      SELECT row_id, 'insurer' AS name, tok AS value, start, stop AS "end", group_index FROM g UNION ALL SELECT row_id, 'amount', ntok, nstart, nstop, group_index FROM g""",
    "word_frequency": r"""SELECT lower(w) AS word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE regexp_matches(w, '[^\p{Z}]') GROUP BY 1 HAVING count(*) >= 2""",
    "symspell_candidates": r"""WITH v AS (SELECT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w FROM benchmark) GROUP BY 1 HAVING count(*) >= 2),
      q AS (SELECT DISTINCT lower(w) AS query FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w FROM conversations))
      SELECT query, word FROM q JOIN v ON abs(length(query) - length(word)) <= 1 WHERE query = word OR list_has_any(
        list_transform(range(0, length(query) + 1), lambda i: substr(query, 1, i) || substr(query, i + 2)), list_transform(range(0, length(word) + 1), lambda i: substr(word, 1, i) || substr(word, i + 2)))
        AND (length(query) <> length(word) AND (list_contains(list_transform(range(0, length(query)), lambda i: substr(query, 1, i) || substr(query, i + 2)), word) OR list_contains(list_transform(range(0, length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)), query))
          OR length(query) = length(word) AND list_sum(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN substr(query, i, 1) = substr(word, i, 1) THEN 0 ELSE 1 END)) <= 1)""",
    "char_ngram_counts": f"""WITH t AS (SELECT {sql_normal('text')} AS t FROM benchmark), g AS (SELECT t, n, unnest(range(1, greatest(0, length(t) - n + 1) + 1)) AS i FROM t CROSS JOIN (VALUES (3), (4), (5)) AS v(n))
      SELECT substr(t, i, n) AS gram, count(*) AS n FROM g GROUP BY 1""",
    "word_ngram_counts": f"""WITH w AS (SELECT doc_id, list_filter(string_split({sql_normal("coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM documents),
      e AS (SELECT unnest(ws) AS gram FROM w UNION ALL SELECT unnest(list_transform(range(1, greatest(1, len(ws))), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w)
      SELECT gram, count(*) AS n FROM e GROUP BY 1""",
    "vectorize_portable": f"WITH {PORTABLE} SELECT doc_id AS row_id, CAST(idx AS INT) AS idx, v FROM e",
    "schema_inference": _inference_sql(),
    "schema_validate": f"WITH {EVENT_ROWS} SELECT event_id, errors, warnings FROM ch",
    "record_import": f"""WITH {EVENT_ROWS} SELECT 'accepted' AS part, count(*) FILTER (errors = '') AS n FROM ch UNION ALL SELECT 'rejected', count(*) FILTER (errors <> '') FROM ch
      UNION ALL SELECT 'warnings', CAST(sum(len(string_split(warnings, '; '))) AS BIGINT) FROM ch""",
    "record_map": "WITH " + EVENT_ROWS + " SELECT event_id, concat_ws(' ', nullif(trim(value), ''), nullif(trim(props), '')) AS feature_text, nullif(trim(event_type), '') AS label FROM ch",
    "nb_train": f"WITH {PORTABLE} SELECT label, CAST(idx AS BIGINT) AS idx, round(total, 6) AS total FROM cnt",
    "nb_predict": f"WITH {SCORED} SELECT doc_id AS row_id, label, round(p, 6) AS confidence FROM rk WHERE place = 1",
    "nb_incremental": f"WITH {PORTABLE} SELECT label, docs, round(mass, 6) AS mass FROM facts",
    "nb_metrics": f"WITH {PORTABLE} SELECT label, docs AS observations FROM docs",
    "prediction_alternatives": f"WITH {SCORED} SELECT doc_id AS row_id, place - 1 AS place, label, round(p, 6) AS probability FROM rk",
    "lr_score_fixed_weights": f"""WITH {PORTABLE}, b AS (SELECT * FROM (VALUES ('good', 0.25::DOUBLE), ('poor', -0.25::DOUBLE)) AS v(label, b)), pool AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lab)),
      g AS (SELECT e.doc_id, label, sum(v * ((idx % 7 - 3) * b / 100)) AS gain FROM e CROSS JOIN b GROUP BY ALL)
      SELECT pool.doc_id AS row_id, b.label, round(b.b + coalesce(gain, 0), 6) + 0.0::DOUBLE AS score FROM pool CROSS JOIN b LEFT JOIN g ON g.doc_id = pool.doc_id AND g.label = b.label""",
    "feature_store_dedup": f"""WITH {PORTABLE}, vec AS (SELECT obs.doc_id, label, coalesce(string_agg(idx || ':' || v, ' ' ORDER BY idx), '') AS x, count(idx) AS buckets FROM obs LEFT JOIN e USING (doc_id) GROUP BY ALL)
      SELECT min(doc_id) AS seq, label, min(buckets) AS buckets FROM vec GROUP BY label, x""",
    "retrain_from_store": f"""WITH {PORTABLE}, vec AS (SELECT obs.doc_id, label, coalesce(string_agg(idx || ':' || v, ' ' ORDER BY idx), '') AS x, coalesce(sum(v), 0) AS m FROM obs LEFT JOIN e USING (doc_id) GROUP BY ALL),
      one AS (SELECT label, x, min(m) AS m FROM vec GROUP BY label, x) SELECT label, count(*) AS docs, round(sum(m), 6) AS mass FROM one GROUP BY label""",
    "codec_aes_roundtrip": f"WITH {PORTABLE} SELECT d.doc_id AS row_id, 32 + 8 * count(idx) AS bytes, count(idx) AS buckets, CAST(coalesce(sum(idx), 0) AS BIGINT) AS indices, coalesce(sum(v), 0)::DOUBLE AS total FROM documents d LEFT JOIN e USING (doc_id) GROUP BY ALL",
    "csv_predict": f"WITH {SCORED} SELECT doc_id AS row_id, label, printf('%.4f', round(round(p, 6), 4)) AS confidence FROM rk WHERE place = 1",
    "log_parse": f"WITH {LOG_LINES} SELECT event_id, level, message FROM pl WHERE level IS NOT NULL",
    "log_watch": f"WITH {LOG_LINES} SELECT event_id, level, CASE level WHEN 'ERROR' THEN 'DB_ERROR' ELSE 'TIMEOUT' END AS anomaly_type FROM pl WHERE level IN ('ERROR', 'WARN')",
    "classify_route_extract": f"""WITH {STATEMENT_TOKENS}, a AS (SELECT row_id, kind, max(tok) FILTER (t = 'ALPHANUMERIC') AS customer FROM tokens GROUP BY ALL),
      am AS (SELECT row_id, string_agg(tok, ' ' ORDER BY pos) FILTER (c = 'M') AS ms, string_agg(tok, ' ' ORDER BY pos) FILTER (c = 'X') AS xs FROM tokens GROUP BY row_id)
      SELECT row_id, kind AS label, CASE kind WHEN 'invoice' THEN 'customer=' || customer || '; total=' || split_part(ms, ' ', 1)
        WHEN 'order' THEN 'insurer=' || split_part(xs, ' ', 1) || '; amount=' || split_part(ms, ' ', 1) || '; insurer=' || split_part(xs, ' ', 2) || '; amount=' || split_part(ms, ' ', 2) ELSE '' END AS fields FROM a JOIN am USING (row_id)""",
    "model_export_text": "",
    "active_learning_margin": _review_sql("-m"),
    "active_learning_least_confidence": _review_sql("1 - top"),
    "active_learning_entropy": _review_sql("h"),
}
ORACLE["nb_predict_joined"] = ORACLE["nb_predict"]
_HEAD = " UNION ALL ".join(f"SELECT {k - 100} AS seq, '{v}' AS value" for k, v in enumerate(header_lines(S.RecordSchema.define().text("text").label("label").build(), NAIVE_BAYES, HASHING)))
ORACLE["model_export_text"] = f"WITH {PORTABLE}, vec AS (SELECT obs.doc_id, label, coalesce(string_agg(idx || ':' || v, ' ' ORDER BY idx), '') AS x FROM obs LEFT JOIN e USING (doc_id) GROUP BY ALL) SELECT seq, md5(value) AS line FROM ({_HEAD} UNION ALL SELECT doc_id, label || chr(9) || x FROM vec)"
