"""Feature assembly, training, prediction and cross-validation of session detectors."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import Settings, settings_from_json
from tracewright.functions import net
from tracewright.functions import numeric as nu
from tracewright.ml import encoder, svm
from tracewright.operators import cv, features, flow, metrics, tokens
from tracewright.runtime import written

EMPTY_HOST, EMPTY_NET = [0.0] * 8, [0.0] * 15


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def host_features(lines: DataFrame) -> DataFrame:
    """(file_name, host_numeric) of audit lines."""
    return tokens.host_counters(lines).select("file_name", F.array(*[F.col(c).cast("double") for c in nu.HOST_NAMES]).alias("host_numeric"))


def packet_names(packets: DataFrame) -> DataFrame:
    """(file, kind, value): distinct DNS names, server names, HTTP hosts and far public addresses of the captures of packets."""
    return capture_names(flow.packet_captures(packets.filter(F.col("error").isNull())))


def packet_features(packets: DataFrame) -> DataFrame:
    """(file, net_numeric, net_text) of the captures of packets: counters, lengths, gaps and names."""
    return capture_features(flow.packet_captures(packets.filter(F.col("error").isNull())))


#: Kinds of names in the order of the network text.
KINDS = ("dns", "sni", "host", "ip")


def _named(kind: str) -> Column:
    """(kind, value) of the names of a kind; DNS names must be valid domains."""
    names = F.filter("dns", net.valid_domain) if kind == "dns" else F.col(kind)
    return F.transform(names, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def capture_names(captures: DataFrame) -> DataFrame:
    """``packet_names`` of captures by row, as ``flow.file_captures`` has them."""
    return captures.select("file", F.inline(F.concat(*map(_named, KINDS))))


def capture_features(captures: DataFrame) -> DataFrame:
    """``packet_features`` of captures by row."""
    d = lambda c: F.col(c).cast("double")
    r = lambda c: F.round(d(c), 4)
    count = lambda kind: F.size(F.filter("__names", lambda x: x["kind"] == kind)).cast("double")
    numbers = [d("packet_count"), d("ip_bytes"), d("ip_up"), d("ip_bytes") - d("ip_up"), nu.ratio(d("ip_up"), d("ip_bytes")), r("len_min"), r("len_max"), r("len_mean"), r("len_std"), r("gap_mean"), r("gap_std"), r("gap_max"), *map(count, KINDS[:3])]
    text = F.array_join(F.transform("__names", lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), " ")
    return captures.withColumn("__names", F.concat(*map(_named, KINDS))).select("file", F.array(*numbers).alias("net_numeric"), text.alias("net_text"))


def assemble(names: DataFrame, corpus: DataFrame, host: DataFrame, network: DataFrame) -> DataFrame:
    """Feature records of ``names`` (file_name, label): absent modalities give zeros, '' and false."""
    return (
        names.join(corpus.withColumnRenamed("text", "audit_text"), "file_name", "left")
        .join(host, "file_name", "left")
        .join(network, "file_name", "left")
        .select(
            "file_name",
            "label",
            F.coalesce("audit_text", F.lit("")).alias("audit_text"),
            F.coalesce("host_numeric", _zeros(8)).alias("host_numeric"),
            F.coalesce("net_text", F.lit("")).alias("net_text"),
            F.coalesce("net_numeric", _zeros(15)).alias("net_numeric"),
            F.col("host_numeric").isNotNull().alias("has_audit"),
            F.col("net_numeric").isNotNull().alias("has_pcap"),
        )
    )


def numeric_block(samples: DataFrame, mode: str = "fusion") -> DataFrame:
    """Samples with ``raw``: the log-scaled counters of the mode, and presence flags in fusion."""
    host, netw = nu.log_selected(F.col("host_numeric"), nu.HOST_LOG), nu.log_selected(F.col("net_numeric"), nu.NET_LOG)
    block = {"fusion": F.concat(host, netw), "audit_only": host, "pcap_only": netw}[mode]
    return samples.withColumn("raw", block).withColumn("flags", nu.flags(F.col("has_audit"), F.col("has_pcap")) if mode == "fusion" else F.array().cast("array<double>"))


def bounds_of(rows: DataFrame, column: str = "raw") -> list[tuple[float, float]]:
    """(low, high) per position: as many rows as positions."""
    return [(r["low"], r["high"]) for r in features.min_max_fit(rows, column).orderBy("i").collect()]


def scaled_block(rows: DataFrame, bounds: list[tuple[float, float]], settings: Settings) -> DataFrame:
    """Rows with ``x``: scaled, weighted counters and flags."""
    hosts = {"fusion": 8, "audit_only": 8, "pcap_only": 0}[settings.mode]
    parts = [nu.min_max(F.get("raw", F.lit(i)), F.lit(lo), F.lit(hi)) * (settings.host_weight if i < hosts else settings.net_weight) for i, (lo, hi) in enumerate(bounds)]
    return rows.withColumn("x", F.concat(F.array(*parts), "flags"))


def text_vocabularies(rows: DataFrame, settings: Settings) -> dict[str, list[tuple[str, float]] | None]:
    """(term, idf) of each text of the mode, fitted on ``rows``; None for a text that is encoded densely."""
    out = {}
    docs = rows.dropDuplicates(["file_name"])
    for column, encoding, limit, _ in _texts(settings):
        out[column] = None
        if encoding == "tfidf":
            counts = features.word_counts(docs, "file_name", column)
            kept = features.tfidf_vocabulary(counts, docs, "file_name", settings.min_df, settings.max_df, limit)
            out[column] = [(r["term"], r["idf"]) for r in kept.orderBy("term").collect()]  # at most ``limit``
    return out


def _texts(settings: Settings) -> list[tuple[str, str, int, str]]:
    """(column, encoding, most terms, presence) of the texts of a mode."""
    audit = ("audit_text", settings.audit_encoder, settings.audit_max_features, "has_audit")
    pcap = ("net_text", settings.net_encoder, settings.net_max_features, "has_pcap")
    return {"fusion": [audit, pcap], "audit_only": [audit], "pcap_only": [pcap]}[settings.mode]


def feature_rows(samples: DataFrame, bounds: list[tuple[float, float]], vocabularies: dict, settings: Settings, encode: encoder.Encoder | None = None) -> tuple[DataFrame, int]:
    """((file_name, idx, value), width): texts, scaled counters and flags, side by side."""
    docs = samples.dropDuplicates(["file_name"])
    out, width = [], 0
    for column, encoding, _, present in _texts(settings):
        if encoding == "tfidf":
            terms = samples.sparkSession.createDataFrame([(t, i, v) for i, (t, v) in enumerate(vocabularies[column], width)], "term string, idx bigint, idf double")
            weights = features.tfidf(features.word_counts(docs, "file_name", column), terms, "file_name").join(terms, "term")
            out.append(weights.select("file_name", "idx", F.col("weight").alias("value")))
            width += len(vocabularies[column])
            continue
        if encoding != "hashing" and encode is None:
            raise ValueError(f"{encoding} needs its encoder")
        vectors = encoder.embed(docs, "file_name", column, encode, settings.chunk_tokens, settings.chunk_stride, settings.pooling, present=present, dim=settings.embedding_dim)
        long = vectors.select("file_name", F.posexplode("embedding").alias("i", "value")).filter(F.col("value") != 0)
        out.append(long.select("file_name", (F.col("i") + width).cast("bigint").alias("idx"), "value"))
        width += settings.embedding_dim
    numbers = scaled_block(numeric_block(docs, settings.mode), bounds, settings).select("file_name", F.posexplode("x").alias("i", "value"))
    out.append(numbers.select("file_name", (F.col("i") + width).cast("bigint").alias("idx"), "value"))
    width += len(bounds) + (2 if settings.mode == "fusion" else 0)
    return reduce(DataFrame.unionByName, out), width


def train(samples: DataFrame, settings: Settings, encode: encoder.Encoder | None = None) -> dict:
    """A model: vocabularies of the texts, bounds of the counters, weights and intercept."""
    rows = written(samples.filter(F.col("label").isin(0, 1)), "samples")
    bounds = bounds_of(numeric_block(rows, settings.mode))
    vocabularies = text_vocabularies(rows, settings)
    long, width = feature_rows(rows, bounds, vocabularies, settings, encode)
    own = long.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("f"))
    data = rows.select("file_name", "label").join(own, "file_name").select(F.col("f.idx").alias("idx"), F.col("f.value").alias("value"), "label")
    weights, intercept = svm.fit_sparse(data, "idx", "value", "label", width, settings.svm_c)
    return {"bounds": bounds, "vocabularies": vocabularies, "weights": weights.tolist(), "intercept": intercept, "settings": json.loads(settings.to_json())}


def predict(samples: DataFrame, model: dict, encode: encoder.Encoder | None = None) -> DataFrame:
    """Samples with score and pred."""
    settings = settings_from_json(json.dumps(model["settings"]))
    rows, _ = feature_rows(samples, [tuple(b) for b in model["bounds"]], model["vocabularies"], settings, encode)
    weights = samples.sparkSession.createDataFrame(list(enumerate(model["weights"])), "idx bigint, weight double")
    scores = svm.sparse_scores(rows, weights, "file_name", model["intercept"])
    return samples.join(scores.select("file_name", "score", F.col("predicted").alias("pred")), "file_name")


def save_bundle(spark: SparkSession, model: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_bundle(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))  # one line


def cross_validate(samples: DataFrame, settings: Settings, group: str = "group_key", encode: encoder.Encoder | None = None) -> dict[str, DataFrame]:
    """Reports of a grouped cross-validation: per_fold, summary, confusion, misclassified."""
    folds = cv.group_folds(samples, group, "label", settings.folds, settings.seed)
    rows = written(samples.join(folds, group), "folds")
    out = None
    for k in range(settings.folds):
        test = rows.filter(F.col("fold") == k)
        model = train(rows.filter(F.col("fold") != k), settings, encode)
        part = predict(test, model, encode).select("file_name", "label", "pred", "fold")
        out = part if out is None else out.unionByName(part)
    done = written(out, "predictions")
    per_fold = metrics.fold_metrics(done)
    wrong = metrics.misclassified(done, "file_name", "fold")
    return {"per_fold": per_fold, "summary": metrics.fold_summary(per_fold), "confusion": metrics.confusion(done), "misclassified": metrics.misclassified_summary(wrong, "file_name")}


def ablation(samples: DataFrame, settings: Settings, encode: encoder.Encoder | None = None) -> DataFrame:
    """Fold summaries of all modes over the same samples."""
    out = None
    for mode in ("fusion", "audit_only", "pcap_only"):
        s = cross_validate(samples, settings.with_(mode=mode), encode=encode)["summary"].withColumn("mode", F.lit(mode))
        out = s if out is None else out.unionByName(s)
    return out
