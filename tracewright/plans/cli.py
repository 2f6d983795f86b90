"""python -m tracewright.plans.cli COMMAND: score a dataset, tokenize logs, train, validate."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import Settings
from tracewright.functions import text as tx
from tracewright.ml import judge
from tracewright.operators import flow, metrics, sessions, tokens, trajectory
from tracewright.plans import detect
from tracewright.sinks import files as out
from tracewright.sources import files, packets


def sample_labels(spark: SparkSession, root: str, samples: DataFrame, mode: int) -> DataFrame:
    """Labels by mode: 0 or 1 for all samples, or results.csv with 0 for absent ones."""
    if mode in (0, 1):
        return files.constant_labels(samples, mode)
    truth = files.truth_table(spark, f"{root}/results.csv").withColumnRenamed("sample_id", "name")
    return sessions.labels_defaulted(samples.select(F.col("sample_id").alias("name")), truth).withColumnRenamed("name", "sample_id")


def score(spark: SparkSession, root: str, label_mode: int, keywords: list[str], model: dict | None = None, modules: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(votes, metrics) of the detectors over a dataset directory; without modules all run.

    Detectors are joined by sample; a sample without a detector's evidence counts as 0 there. The rule
    searches the whole audit.log, and the session only of a sample that has none.
    """
    modules = modules or ("pcap", "session", "rule")
    samples = files.sample_folders(spark, root)
    votes = samples.select("sample_id").join(sample_labels(spark, root, samples, label_mode), "sample_id")
    log = files.session_lines(spark, root)
    text = trajectory.rendered(trajectory.turns(trajectory.messages(log)))
    if "pcap" in modules:
        vote = F.lit(0)
        if model:
            names = samples.filter(F.col("pcap_path").isNotNull()).select(F.col("pcap_path").alias("file_name"), F.lit(None).cast("int").alias("label"))
            network = detect.capture_features(flow.file_captures(packets.captures(spark, root))).withColumnRenamed("file", "file_name")
            none = spark.createDataFrame([], "file_name string, text string"), spark.createDataFrame([], "file_name string, host_numeric array<double>")
            p = detect.predict(detect.assemble(names, *none, network), model).select(F.regexp_extract("file_name", r"([^/]+)/[^/]+$", 1).alias("sample_id"), F.col("pred").alias("pcap"))
            votes = votes.join(p, "sample_id", "left")
        else:
            votes = votes.withColumn("pcap", vote)
    if "session" in modules:
        s = judge.judge_sessions(text, "session_id", "text").select(F.col("session_id").alias("sample_id"), F.col("label").alias("session"))
        votes = votes.join(s, "sample_id", "left")
    if "rule" in modules:
        audit = files.audit_texts(spark, root)
        searched = audit.unionByName(text.select(F.col("session_id").alias("sample_id"), F.col("text").alias("content")).join(audit.select("sample_id"), "sample_id", "left_anti"))
        r = sessions.keyword_hits(searched, "content", keywords).select("sample_id", F.lit(1).alias("rule")).distinct()
        votes = votes.join(r, "sample_id", "left")
    votes = votes.select("sample_id", "label", *[(F.coalesce(F.col(m), F.lit(0)) == 1).alias(m) for m in modules])
    return votes, metrics.union_metrics(votes, list(modules))


def tokenize(spark: SparkSession, logs: str, target: str, stage: str = "all") -> None:
    """Token counts and distribution of a folder of audit logs, written below ``target``.

    Stage ``tokenize`` writes the fact table, ``stats`` reads it again; counts are unfiltered in ``all``
    and without the skipped prefixes in ``stats``.
    """
    if stage in ("all", "tokenize"):
        out.write_token_table(tokens.counts_per_file(files.audit_lines(spark, logs)), f"{target}/per_file_counts")
    if stage in ("all", "stats"):
        facts = spark.read.parquet(f"{target}/per_file_counts")
        n = tokens.file_count(facts).first()[0]
        out.write_token_counts(tokens.total_counts(facts, filtered=stage == "stats"), n, f"{target}/token_counts")
        out.write_distribution(tokens.token_distribution(facts), f"{target}/distribution")


def labelled_samples(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """Feature records of a labelled dataset, with group_key."""
    names = files.labelled_names(spark, root)
    side = lambda k: names.filter(F.col("kind") == k).select("name", "label").distinct()
    audit, pcap = side("audit"), side("pcap")
    keep = sessions.resolve(settings.mode, audit, pcap, require_both=settings.require_both).withColumnRenamed("name", "file_name")
    if settings.max_samples_per_class:
        keep = tokens.sample_cap(keep, "label", "file_name", settings.max_samples_per_class)
    lines = files.audit_lines(spark, f"{root}/*-by-type/audit-logs")
    network = detect.capture_features(flow.file_captures(packets.captures(spark, f"{root}/*-by-type/network"))).withColumn("file_name", tx.audit_name(files.base_name(F.col("file")))).drop("file")
    said = tokens.capped_documents(tokens.counts_per_file(lines), settings.max_repeat)
    corpus = said.join(tokens.host_payload(lines), "file_name", "full").select("file_name", F.trim(F.concat_ws(" ", "text", "payload")).alias("text"))
    return detect.assemble(keep, corpus, detect.host_features(lines), network).withColumn("group_key", tx.cv_group(F.col("label"), F.col("file_name")))


def main(argv: list[str] | None = None) -> None:
    from tracewright.runtime import local_session

    p = argparse.ArgumentParser(prog="tracewright")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("score")
    s.add_argument("--dataset", required=True)
    s.add_argument("--label-mode", type=int, choices=(0, 1, 2), default=2)
    s.add_argument("--keywords", required=True)
    s.add_argument("--model")
    for m in ("pcap", "session", "rule"):
        s.add_argument(f"--run-{m}", action="store_true")
    t = sub.add_parser("tokenize")
    t.add_argument("--logs", required=True)
    t.add_argument("--target", required=True)
    t.add_argument("--stage", choices=("all", "tokenize", "stats"), default="all")
    for name in ("train", "validate", "evaluate"):
        x = sub.add_parser(name)
        x.add_argument("--dataset", required=True)
        x.add_argument("--model", required=True)
        x.add_argument("--mode", default="fusion")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if a.command == "score":
        chosen = tuple(m for m in ("pcap", "session", "rule") if getattr(a, f"run_{m}"))
        _, m = score(spark, a.dataset, a.label_mode, files.keyword_list(spark, a.keywords), detect.load_bundle(spark, a.model) if a.model else None, chosen)
        m.orderBy(F.length("detectors"), "detectors").show(truncate=False)
    elif a.command == "tokenize":
        tokenize(spark, a.logs, a.target, a.stage)
    else:
        settings = Settings(mode=a.mode)
        samples = labelled_samples(spark, a.dataset, settings)
        if a.command == "train":
            detect.save_bundle(spark, detect.train(samples, settings), a.model)
        elif a.command == "validate":
            done = detect.predict(samples, detect.load_bundle(spark, a.model))
            out.write_csv(metrics.prediction_table(done, "file_name", "has_audit", "has_pcap"), f"{a.model}-predictions")
            out.write_metrics(metrics.classification(done), f"{a.model}-metrics")
            out.write_csv(metrics.confusion(done), f"{a.model}-confusion", one_file=True)
        else:
            out.write_cv(detect.cross_validate(samples, settings), a.model, a.mode)


if __name__ == "__main__":
    main()
