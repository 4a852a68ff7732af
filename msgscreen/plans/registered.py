"""Every operator as a query over the test tables: ``(spark, sf_dir) -> DataFrame``.

Results are flat and scalar, so that any SQL engine can state the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import anonymize as an
from ..operators import handoff as ho
from ..operators import calibration, gazetteer, pii, rollups, routing, scores, secret_rules, secrets, sessions, sketches, spans
from ..operators import restore as rs
from ..operators import requeue as rq
from ..operators import toxicity_ml as ml
from ..operators.reuse import VerdictStore, scan_reusing
from ..sources.messages import (
    conversations_as_messages,
    corpus,
    credential_messages,
    dealt_out,
    derived_messages,
    documents_as_messages,
    event_messages,
    table,
    tasks_for,
)
from ..sources.ledger import BatchLedger
from ..sources.storage import shared_dir, write_responses
from ..streaming.stream import start_scan, stream_files
from . import scan as sc

STRICT = ScreenConfig(mode="strict", recognizers=("ip",))
WITH_IP = ScreenConfig(recognizers=("ip",))
ALL_RECOGNIZERS = spans.STANDARD_RECOGNIZERS + ("ip",)
# A caller's own credential rule, to exercise the slot for one.
EXTRA_SECRET_RULES = (("ticket_ref", r"\bref \d{7}\b", 0.6),)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages; the setting ``msgscreen.partitions``, if the caller makes it, deals them out anew."""
    partitions = spark.conf.get("msgscreen.partitions", None)
    return corpus(spark, sf_dir, partitions and int(partitions))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.learn_lexicon(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


_stored_lexicons: dict[tuple[str, str], str] = {}


def stored_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of a folder, learned once per application and read from the shared folder from then on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored_lexicons:
        path = shared_dir(spark, "lexicon")
        lexicon(spark, sf_dir).write.parquet(path)
        _stored_lexicons[key] = path
    return spark.read.schema("word string, toxic_docs long, clean_docs long, weight double").parquet(_stored_lexicons[key])


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.scan_wide(messages(spark, sf_dir), lexicon=stored_lexicon(spark, sf_dir))


def _listed(df: DataFrame, array, name: str) -> DataFrame:
    """One row per array element with its position."""
    rows = df.select("msg_id", F.posexplode_outer(array).alias("seq", name))
    return rows.where(F.col(name).isNotNull())


# --- sources, gates, sinks --------------------------------------------------
def msg_source(spark, sf_dir):
    return messages(spark, sf_dir)


def reject_empty(spark, sf_dir):
    return routing.rejected(messages(spark, sf_dir))


def token_count(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", tx.token_count(F.col("message")).alias("token_count"))


def token_limit(spark, sf_dir):
    return sc.gate(messages(spark, sf_dir)).select(
        "msg_id",
        "char_count",
        "too_long",
        F.when(F.col("too_long"), "token_limit").alias("violation"),
        F.when(F.col("too_long"), F.lit(fv.TOKEN_LIMIT_CONFIDENCE)).alias("confidence"),
        F.length("scan_text").alias("scanned_chars"),
    )


def truncate_model_input(spark, sf_dir):
    return sc.gate(messages(spark, sf_dir)).select("msg_id", "model_text")


def length_label(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", tx.length_label(F.length("message")).alias("length_label"))


def confidence_label(spark, sf_dir):
    """The label of every violation's confidence."""
    found = violations(spark, sf_dir)
    return found.select("msg_id", "seq", "confidence", tx.confidence_label(F.col("confidence")).alias("confidence_label"))


# --- personal data ----------------------------------------------------------
def _values(find):
    def query(spark, sf_dir):
        return _listed(messages(spark, sf_dir), find("message"), "value")

    return query


def pii_values_by_type(spark, sf_dir):
    """Primary IP values ahead of the supplement, as merged for redaction."""
    df = an.with_token_spans(messages(spark, sf_dir), spans.named_recognizers(("ip",)))
    merged = pii.merge_values(
        {"IP_ADDRESS": F.expr("transform(token_spans, s -> s.value)")}, pii.supplement_values("message")
    )
    rows = df.select("msg_id", F.posexplode_outer(pii.values_by_type(merged)).alias("type_seq", "e"))
    return rows.where(F.col("e").isNotNull()).select(
        "msg_id",
        "type_seq",
        F.col("e.type").alias("type"),
        F.size("e.values").alias("n_values"),
        F.array_join("e.values", "|").alias("joined_values"),
    )


def _span_rows(df: DataFrame, column: str, *fields: str) -> DataFrame:
    rows = df.select("msg_id", F.explode_outer(column).alias("s")).where(F.col("s").isNotNull())
    renamed = {"start": "span_start", "end": "span_end"}
    return rows.select("msg_id", *[F.col(f"s.{f}").alias(renamed.get(f, f)) for f in fields])


def pii_spans(spark, sf_dir):
    df = spans.with_spans(messages(spark, sf_dir), "message", spans.named_recognizers(ALL_RECOGNIZERS))
    return _span_rows(df, "spans", "start", "end", "type", "score", "value")


def pii_score_filter(spark, sf_dir):
    df = spans.with_spans(messages(spark, sf_dir), "message", spans.named_recognizers(ALL_RECOGNIZERS))
    df = df.withColumn("kept", spans.score_filter("spans"))
    return _span_rows(df, "kept", "start", "end", "type", "score")


def _numbered(spark, sf_dir):
    return an.with_token_spans(messages(spark, sf_dir), spans.named_recognizers(ALL_RECOGNIZERS))


def pii_token_number(spark, sf_dir):
    return _span_rows(_numbered(spark, sf_dir), "token_spans", "start", "end", "type", "token")


def pii_redact_spans(spark, sf_dir):
    df = _numbered(spark, sf_dir)
    return df.select("msg_id", spans.redact_spans("message", "token_spans").alias("redacted"))


def pii_token_scan(spark, sf_dir):
    return _listed(pii_redact_spans(spark, sf_dir), an.find_tokens("redacted"), "token")


def pii_token_bind(spark, sf_dir):
    """Entities bound to tokens in the text, typed ones included."""
    df = an.anonymize(messages(spark, sf_dir), ScreenConfig(recognizers=ALL_RECOGNIZERS))
    return an.explode_entities(df, "msg_id").where(F.col("source") == "pii").drop("source", "seq")


def pii_redact_fallback(spark, sf_dir):
    return an.anonymize(messages(spark, sf_dir)).select("msg_id", "sanitized_text")


def pii_entity_dedup(spark, sf_dir):
    return an.explode_entities(an.anonymize(messages(spark, sf_dir), WITH_IP), "msg_id")


def pii_entities(spark, sf_dir):
    return an.explode_entities(an.anonymize(messages(spark, sf_dir)), "msg_id")


def anonymize(spark, sf_dir):
    df = messages(spark, sf_dir).withColumn("types", secrets.secret_types("message"))
    out = an.anonymize(df, WITH_IP).withColumn("s", secrets.secret_verdict("types", "0D"))
    return out.select(
        "msg_id",
        "sanitized_text",
        F.size("entities").alias("n_entities"),
        F.col("s.detected").alias("secrets_detected"),
        F.col("s.is_valid").alias("secrets_valid"),
        F.col("s.risk_score").alias("secrets_risk_score"),
        F.array_join("s.custom_secrets_types", ",").alias("secret_types"),
    )


def anonymize_strict(spark, sf_dir):
    out = an.anonymize(messages(spark, sf_dir), STRICT)
    return out.select("msg_id", "sanitized_text", F.size("entities").alias("n_entities"))


def stored_phrases(spark, sf_dir):
    """A dictionary of product names and of the last words of some, which longer ones must win over."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("phrase"), F.lit("PRODUCT").alias("type"))
    last = part.select(F.element_at(F.split("p_name", " "), -1).alias("phrase"), F.lit("THING").alias("type"))
    path = shared_dir(spark, "phrases")
    gazetteer.dictionary(names.unionByName(last)).write.parquet(path)
    return spark.read.parquet(path)


def pii_gazetteer(spark, sf_dir):
    found = gazetteer.find_phrases(with_credentials(spark, sf_dir), stored_phrases(spark, sf_dir))
    return found.select("msg_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "type", "value")


VAULT_SECRET = "a secret of the caller"


def restore(spark, sf_dir):
    """Every message redacted under keyed tokens, sent back as a reply, and restored from the vault."""
    path = shared_dir(spark, "protected")
    rs.protect(messages(spark, sf_dir).select("msg_id", "message"), VAULT_SECRET, config=STRICT).drop("message").write.parquet(path)
    protected = spark.read.parquet(path)
    replies = protected.select("msg_id", F.col("protected_text").alias("reply"))
    return rs.restore(replies, rs.vault_rows(protected, "msg_id")).select("msg_id", "reply", "restored")


# --- credentials ------------------------------------------------------------
def _secret(pattern_no: int):
    def query(spark, sf_dir):
        return _listed(messages(spark, sf_dir), secrets.secret_matches("message", pattern_no), "matched")

    return query


def secret_findings(spark, sf_dir):
    rows = messages(spark, sf_dir).select("msg_id", F.explode_outer(secrets.secret_hits("message")).alias("h"))
    return rows.where(F.col("h").isNotNull()).select("msg_id", "h.pattern_no", "h.type")


def secret_summary(spark, sf_dir):
    rows = messages(spark, sf_dir).select("source", F.explode_outer(secrets.secret_hits("message")).alias("h"))
    long = rows.where(F.col("h").isNotNull()).select("source", "h.type")
    return long.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n_hits"))


def secret_verdict(spark, sf_dir):
    df = messages(spark, sf_dir).withColumns(
        {
            "types": secrets.secret_types("message"),
            "risk": secrets.extra_risk("message", EXTRA_SECRET_RULES),
        }
    )
    out = df.withColumn("s", secrets.secret_verdict("types", "risk"))
    return out.select(
        "msg_id",
        F.col("s.detected").alias("detected"),
        F.col("s.is_valid").alias("is_valid"),
        F.col("s.risk_score").alias("risk_score"),
        F.array_join("s.custom_secrets_types", ",").alias("secret_types"),
    )


def credentials(spark, sf_dir):
    """Messages that hold further kinds of credentials."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return credential_messages(dealt_out(part, tasks_for(part)))


def with_credentials(spark, sf_dir):
    """All messages and those that hold further kinds of credentials."""
    return messages(spark, sf_dir).unionByName(credentials(spark, sf_dir))


def secret_rule_findings(spark, sf_dir):
    found = secret_rules.rule_findings(with_credentials(spark, sf_dir), "message", secret_rules.DEFAULT_RULES, "msg_id")
    return found.select("msg_id", "rule", "seq", "value", "entropy")


def scan_credentials(spark, sf_dir):
    """Verdicts on the messages with further credentials, and what they are without the rules."""
    df = credentials(spark, sf_dir)
    verdict = lambda config, name: sc.scan(df, config).select("msg_id", F.col("allowed").alias(name))
    # Both sides are as long as the table, however small the file of keys makes them look: neither is broadcast.
    return verdict(ScreenConfig(), "allowed").join(verdict(ScreenConfig(secret_rules=()), "allowed_without_rules").hint("merge"), "msg_id")


# --- scores -----------------------------------------------------------------
def injection_score(spark, sf_dir):
    gated = sc.gate(messages(spark, sf_dir))
    return gated.select("msg_id", scores.injection_score("scan_text").alias("injection_score"))


def toxicity_lexicon(spark, sf_dir):
    return lexicon(spark, sf_dir)


def toxicity_score(spark, sf_dir):
    gated = sc.gate(messages(spark, sf_dir))
    return scores.with_toxicity_score(gated, "scan_text", stored_lexicon(spark, sf_dir)).select("msg_id", "toxicity_score")


def toxicity_ml(spark, sf_dir):
    """Held-out flags, score range, and whether toxic documents score higher than clean ones, which no constant does.

    All labelled documents count here, as small tables hold none out; a test has the held-out ranking.
    """
    scored = toxicity_ml_scores(spark, sf_dir)
    held = scored.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    apart = held.agg((F.avg(F.when(F.col("toxic") == 1, F.col("toxicity_score"))) - F.avg(F.when(F.col("toxic") == 0, F.col("toxicity_score")))).alias("d"))
    return scored.select(
        "doc_id",
        "held_out",
        F.col("toxicity_score").between(0.0, 1.0).alias("in_range"),
        (F.coalesce(apart.select("d").scalar(), F.lit(0.0)) > 0.1).alias("tells_apart"),
    )


def toxicity_ml_scores(spark, sf_dir):
    return ml.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


_stored_models: dict[tuple[str, str], str] = {}


def stored_model(spark, sf_dir):
    """The naive Bayes model of a folder's labelled documents that are not held out: fitted once, saved, loaded."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored_models:
        path = shared_dir(spark, "toxicity-model")
        labels = table(spark, sf_dir, "labels").where(~ml.is_held_out())
        ml.save(ml.train_bayes(table(spark, sf_dir, "documents").select("doc_id", "text"), labels), path)
        _stored_models[key] = path
    return ml.load(_stored_models[key])


def scan_with_model(spark, sf_dir):
    """Scores and verdicts of a scan whose toxicity score is that of the saved model."""
    found = sc.scan_wide(messages(spark, sf_dir), toxicity_pipeline=stored_model(spark, sf_dir))
    return found.select("msg_id", F.round("toxicity_score", 6).alias("toxicity_score"), "has_toxicity", "allowed", F.array_join("violations.type", ",").alias("violation_types"))


def threshold_apply(spark, sf_dir):
    """Looser cut-offs than the defaults, so that every rule weight is told apart."""
    config = ScreenConfig(injection_threshold=0.9, toxicity_threshold=0.95)
    return sc.scan_wide(messages(spark, sf_dir), config, stored_lexicon(spark, sf_dir)).select(
        "msg_id", "injection_score", "toxicity_score", "has_injection", "has_toxicity"
    )


def threshold_curve(spark, sf_dir):
    """What each cut-off of the saved model's score would do to the documents it never saw."""
    documents = table(spark, sf_dir, "documents").where(ml.is_held_out()).select("doc_id", "text")
    scored = ml.with_model_score(documents, "text", stored_model(spark, sf_dir), "score").join(table(spark, sf_dir, "labels"), "doc_id")
    curve = calibration.threshold_curve(scored.withColumn("score", F.round("score", 6)), "score", "toxic")
    return curve.select("threshold", "n", "n_positive", "flagged", "true_positives", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "calibrated")))


# --- verdict ----------------------------------------------------------------
def violations(spark, sf_dir):
    rows = scanned(spark, sf_dir).select("msg_id", F.posexplode_outer("violations").alias("seq", "v"))
    return rows.where(F.col("v").isNotNull()).select("msg_id", "seq", "v.type", "v.confidence", "v.action")


def primary_violation(spark, sf_dir):
    return scanned(spark, sf_dir).select(
        "msg_id",
        F.col("primary_violation.type").alias("primary_type"),
        F.col("primary_violation.confidence").alias("primary_confidence"),
    )


def allowed(spark, sf_dir):
    return scanned(spark, sf_dir).select("msg_id", "allowed")


def anonymized_prompt(spark, sf_dir):
    return scanned(spark, sf_dir).select("msg_id", "has_pii", "anonymized_prompt")


def tone_lookup(spark, sf_dir):
    """Tone per violation, and the defaults for a type nobody lists: the message source."""
    listed = scanned(spark, sf_dir).select(
        "msg_id", F.explode(F.concat(F.array(F.col("source")), F.col("detected_threats"))).alias("type")
    )
    return listed.select(
        "msg_id", "type", ho.tone("type").alias("tone"), ho.instruction("type").alias("instruction")
    )


def handoff(spark, sf_dir):
    h = "llm_handoff"
    return scanned(spark, sf_dir).select(
        "msg_id",
        F.col(f"{h}.violation_type").alias("violation_type"),
        F.col(f"{h}.confidence_label").alias("confidence_label"),
        F.col(f"{h}.message_length_label").alias("message_length_label"),
        F.col(f"{h}.suggested_tone").alias("suggested_tone"),
        F.col(f"{h}.prompt_for_llm").alias("prompt_for_llm"),
    )


def detected_threats(spark, sf_dir):
    return scanned(spark, sf_dir).select(
        "msg_id", F.array_join("detected_threats", ",").alias("detected_threats"), "risk_level"
    )


def scan_metrics(spark, sf_dir):
    return rollups.scan_metrics(scanned(spark, sf_dir))


def metric_sketches(spark, sf_dir):
    """Exact counts per source, and whether figures merged from three stored batches are within their stated errors."""
    path = shared_dir(spark, "scanned")
    rows = sc.scan(messages(spark, sf_dir), lexicon=stored_lexicon(spark, sf_dir))
    rows.select("msg_id", "source", "session_id", "original_prompt", "token_count", "allowed").write.parquet(path)
    rows = spark.read.parquet(path)
    stored = shared_dir(spark, "sketches")
    for batch in range(3):
        part = rows.where(F.pmod(F.xxhash64("msg_id"), F.lit(3)) == batch)
        sketches.batch_sketches(part, "source").write.mode("append").parquet(stored)
    found = sketches.figures(sketches.merged(spark.read.parquet(stored), "source"), "source")
    found = found.withColumnRenamed("source", "by").drop("n_messages", "n_blocked")
    joined = rows.join(F.broadcast(found), rows["source"].eqNullSafe(found["by"]))  # a row a source
    near = lambda estimate, exact: F.abs(estimate - exact) <= sketches.DISTINCT_ERROR * exact + 1

    def rank_near(column, share):
        n, e = F.count(F.lit(1)), sketches.RANK_ERROR
        return (F.count_if(F.col("token_count") < F.col(column)) <= (share + e) * n) & (F.count_if(F.col("token_count") <= F.col(column)) >= (share - e) * n)

    texts, talks = F.count_distinct("original_prompt"), F.count_distinct("session_id")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(~F.col("allowed")).alias("n_blocked"),
        texts.alias("distinct_texts"),
        talks.alias("distinct_sessions"),
        near(F.first("distinct_texts"), texts).alias("texts_within"),
        near(F.first("distinct_sessions"), talks).alias("sessions_within"),
        rank_near("tokens_p50", 0.5).alias("p50_within"),
        rank_near("tokens_p95", 0.95).alias("p95_within"),
    )


def session_rollup(spark, sf_dir):
    return rollups.session_rollup(scanned(spark, sf_dir), "source", "session_id")


def violation_rollup(spark, sf_dir):
    return rollups.violation_rollup(scanned(spark, sf_dir), "source")


def session_risk(spark, sf_dir):
    """The risk that each conversation has gathered by each of its turns."""
    turns = conversations_as_messages(table(spark, sf_dir, "conversations"))
    turns = turns.withColumn("turn", F.element_at(F.split("msg_id", "-"), -1).cast("int"))
    found = sc.scan_wide(turns, lexicon=stored_lexicon(spark, sf_dir))
    return sessions.running_risk(found, "turn").drop("session_id")


def session_gaps(spark, sf_dir):
    """Messages of the event log by senders, six quiet hours apart."""
    found = sc.scan(event_messages(table(spark, sf_dir, "events")))
    return sessions.gap_sessions(found, "session_id", "ts", "6 hours")


# --- whole jobs -------------------------------------------------------------
def scan(spark, sf_dir):
    responses = sc.scan(messages(spark, sf_dir), lexicon=stored_lexicon(spark, sf_dir))
    return sc.flatten(responses, "msg_id", "source", "session_id")


def scan_response(spark, sf_dir):
    """The response contract without the lexicon, as a first run has none."""
    return sc.flatten(sc.scan(messages(spark, sf_dir)), "msg_id")


def sink_roundtrip(spark, sf_dir):
    """The response sink, partitioned by verdict, written and read back."""
    path = shared_dir(spark, "responses")
    responses = sc.scan(messages(spark, sf_dir))
    write_responses(responses, path)
    # The schema is given: a partition column read without one is text.
    return sc.flatten(spark.read.schema(responses.schema).parquet(path), "msg_id")


def scan_dedup(spark, sf_dir):
    responses = sc.scan_distinct(messages(spark, sf_dir), lexicon=stored_lexicon(spark, sf_dir))
    return sc.flatten(responses, "msg_id", "source", "session_id")


def scan_reuse(spark, sf_dir):
    """All messages after half of them: the second run scans only texts the first one didn't."""
    store, df, lexicon_ = VerdictStore(spark, shared_dir(spark, "verdicts")), messages(spark, sf_dir), stored_lexicon(spark, sf_dir)
    half = df.where(F.pmod(F.xxhash64("msg_id"), F.lit(2)) == 0)
    scan_reusing(half, store, lexicon=lexicon_)
    return sc.flatten(scan_reusing(df, store, lexicon=lexicon_), "msg_id", "source", "session_id")


def scan_strict(spark, sf_dir):
    return sc.flatten(sc.scan(messages(spark, sf_dir), STRICT), "msg_id")


def route_messages(spark, sf_dir):
    responses = sc.scan(messages(spark, sf_dir), lexicon=stored_lexicon(spark, sf_dir))
    return routing.route(responses).select("msg_id", "route", "outgoing_prompt")


def _ip_model():
    """Loader of a caller's recogniser that refuses texts with impossible addresses."""
    pattern_text = fv.IP_LIKE_PATTERN

    def load():
        import re

        pattern = re.compile(pattern_text)

        def recognize(text):
            found = []
            for m in pattern.finditer(text):
                if any(int(part) > 255 for part in m.group().split(".")):
                    raise ValueError(f"impossible address {m.group()}")
                found.append(("IP_ADDRESS", m.start(), m.end(), 0.6))
            return found

        return recognize

    return load


def quarantine(spark, sf_dir):
    """Rows on which the caller's recogniser failed: unscanned, held, with the reason."""
    responses = sc.scan(messages(spark, sf_dir), span_model=_ip_model())
    return routing.quarantined(routing.route(responses)).select(
        "msg_id", "route", "reason", "anonymized_prompt", "allowed", F.array_join("violations.type", ",").alias("violation_types")
    )


def requeue(spark, sf_dir):
    """Rows on which the caller's recogniser failed, scanned again without it; each batch counts once in its ledger."""
    ledger = BatchLedger(spark, shared_dir(spark, "ledger"))
    first = sc.scan(messages(spark, sf_dir).select("msg_id", "message"), span_model=_ip_model()).withColumn("attempts", F.lit(0))
    path = shared_dir(spark, "first-scan")
    first.write.parquet(path)
    first = spark.read.parquet(path)
    columns = ["msg_id", "attempts", "allowed", "anonymized_prompt", "pii_scanner_error"]
    ledger.write("first", rq.settled(first).select(columns))
    again = rq.rescan(rq.to_requeue(first, ("msg_id",)), sc.scan)
    for _ in range(2):  # the second time changes nothing
        ledger.write("again", rq.settled(again).select(columns))
    return ledger.read(rq.settled(first).select(columns).schema).drop("pii_scanner_error")


def plugin_redaction(spark, sf_dir):
    """Redaction with the caller's recogniser ahead of the supplement."""
    responses = sc.scan(messages(spark, sf_dir), span_model=_ip_model())
    return responses.select("msg_id", "allowed", "anonymized_prompt", "pii_scanner_error")


def stream_scan(spark, sf_dir):
    """The scan as a stream over all three tables, read back from its sink."""
    return _streamed(spark, sf_dir, ScreenConfig(), per_batch=False)


def stream_scan_join(spark, sf_dir):
    """The same batch by batch, the lexicon joined as one of any size would be."""
    return _streamed(spark, sf_dir, ScreenConfig(lexicon_in_row=False), per_batch=True)


def stream_reuse(spark, sf_dir):
    """A file a batch, with verdicts kept in a store over the batches."""
    store = VerdictStore(spark, shared_dir(spark, "verdicts"))
    reusing = lambda batch, config, learned: scan_reusing(batch, store, config, learned)
    return _streamed(spark, sf_dir, ScreenConfig(), per_batch=True, scan=reusing, files=1)


def _streamed(spark, sf_dir, config, per_batch, scan=sc.scan, files=1000):
    work = shared_dir(spark, "stream-scan")
    learned = stored_lexicon(spark, sf_dir)
    partitions = spark.conf.get("msgscreen.partitions", None)

    def source(name):
        # A pattern of one name: a table may be a file or a folder of them, and both must stream.
        return stream_files(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, max_files_per_batch=files)

    # A stream can't be counted ahead, the table it comes from can.
    keys, tasks = source("customer").select("c_custkey"), 1 if partitions else tasks_for(table(spark, sf_dir, "customer"))
    arriving = (
        documents_as_messages(source("documents"))
        .unionByName(conversations_as_messages(source("conversations")))
        .unionByName(derived_messages(dealt_out(keys, tasks)))
    )
    query = start_scan(
        arriving,
        lambda m: scan(m, config, learned),
        f"{work}/out",
        f"{work}/checkpoint",
        tasks=partitions and int(partitions),
        per_batch=per_batch,
    )
    query.awaitTermination()
    return sc.flatten(spark.read.parquet(f"{work}/out"), "msg_id", "route")


QUERIES = {
    "msg_source": msg_source,
    "reject_empty": reject_empty,
    "token_count": token_count,
    "token_limit": token_limit,
    "truncate_model_input": truncate_model_input,
    "length_label": length_label,
    "confidence_label": confidence_label,
    "pii_email": _values(pii.emails),
    "pii_phone": _values(pii.phones),
    "pii_ssn": _values(pii.ssns),
    "pii_card": _values(pii.cards),
    "pii_name_intro": _values(pii.introduced_names),
    "pii_name_greeting": _values(pii.greeted_names),
    "pii_values_by_type": pii_values_by_type,
    "pii_spans": pii_spans,
    "pii_score_filter": pii_score_filter,
    "pii_token_number": pii_token_number,
    "pii_redact_spans": pii_redact_spans,
    "pii_token_scan": pii_token_scan,
    "pii_token_bind": pii_token_bind,
    "pii_redact_fallback": pii_redact_fallback,
    "pii_entity_dedup": pii_entity_dedup,
    "pii_entities": pii_entities,
    "pii_gazetteer": pii_gazetteer,
    "restore": restore,
    "anonymize": anonymize,
    "anonymize_strict": anonymize_strict,
    "sec_api_key_assign": _secret(0),
    "sec_api_key_prefix": _secret(1),
    "sec_github": _secret(2),
    "sec_google": _secret(3),
    "sec_password": _secret(4),
    "sec_secret_assign": _secret(5),
    "sec_bearer": _secret(6),
    "sec_aws": _secret(7),
    "secret_findings": secret_findings,
    "secret_summary": secret_summary,
    "secret_verdict": secret_verdict,
    "secret_rules": secret_rule_findings,
    "scan_credentials": scan_credentials,
    "injection_score": injection_score,
    "toxicity_lexicon": toxicity_lexicon,
    "toxicity_score": toxicity_score,
    "toxicity_ml": toxicity_ml,
    "threshold_apply": threshold_apply,
    "violations": violations,
    "primary_violation": primary_violation,
    "allowed": allowed,
    "anonymized_prompt": anonymized_prompt,
    "tone_lookup": tone_lookup,
    "handoff": handoff,
    "detected_threats": detected_threats,
    "scan_metrics": scan_metrics,
    "session_rollup": session_rollup,
    "violation_rollup": violation_rollup,
    "metric_sketches": metric_sketches,
    "requeue": requeue,
    "session_risk": session_risk,
    "session_gaps": session_gaps,
    "threshold_curve": threshold_curve,
    "scan": scan,
    "scan_response": scan_response,
    "sink_roundtrip": sink_roundtrip,
    "scan_dedup": scan_dedup,
    "scan_reuse": scan_reuse,
    "scan_with_model": scan_with_model,
    "scan_strict": scan_strict,
    "route_messages": route_messages,
    "quarantine": quarantine,
    "plugin_redaction": plugin_redaction,
    "stream_scan": stream_scan,
    "stream_scan_join": stream_scan_join,
    "stream_reuse": stream_reuse,
}
