"""Comparisons of methods and branches: scores with zero for what is missing, pivots by field, deltas with a verdict, diagnostics, and the gate before a model is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as R
from ..functions import text as T
from .evidence import top_k

# Component types that are identifiers, and those that bear text.
IDENTIFIER_TYPES = ["barcode", "database_label", "number"]
TEXT_TYPES = ["primary_specimen_label", "printed_label", "database_label", "number", "annotation_label", "handwritten_data", "type_label"]
#: Fields with a column of their own in the table of branches.
SHOWN = ["catalogNumber", "scientificName", "recordedBy", "eventDate"]


def branch_detail(predicted: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """record, branch, field, prediction, gold, coverage, exact_match, token_f1, review_required; only where there is a gold value, and zeros where there is no prediction.

    `predicted` has record, branch, the fields and <field>_review_required (textual or boolean flags); one equi-join by record.
    """
    said = predicted.select("record", "branch", *(T.clean(F.col(f)).alias(f"{f}_said") for f in fields), *(R.truthy(F.col(f"{f}_review_required").cast("string")).alias(f"{f}_review") for f in fields))
    truth = gold.select("record", *(T.clean(F.col(f)).alias(f"{f}_gold") for f in fields)).filter(F.concat(*(f"{f}_gold" for f in fields)) != "")
    wide = said.join(truth.hint("merge"), "record")  # both grow alike: neither is broadcast
    # Each value by the rule of its own field, before a record becomes a row a field: rows that are joined and sorted are fewer, and no rule is asked for in vain.
    normal = lambda f, c: F.when(F.col(f"{f}_gold") != "", R.normal_value(F.lit(f), F.col(f"{f}_{c}"), cleaned=True))
    wide = wide.withColumns({f"{f}_{name}": normal(f, c) for f in fields for name, c in (("p", "said"), ("g", "gold"))})
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{f}_said").alias("prediction"), F.col(f"{f}_gold").alias("gold"), F.col(f"{f}_p").alias("p"), F.col(f"{f}_g").alias("g"), F.col(f"{f}_review").alias("review_required"))
    rows = wide.select("record", "branch", F.inline(F.array(*map(one, fields)))).filter("gold <> ''")
    field, pred, value = F.col("field"), F.col("prediction"), F.col("gold")
    rows = rows.withColumn("exact", R.exact_of(field, pred, value, F.col("p"), F.col("g")))
    there = pred != ""
    scored = lambda c, zero: F.when(there, c).otherwise(zero)
    return rows.select("record", "branch", "field", "prediction", "gold", there.cast("double").alias("coverage"), scored(F.col("exact"), 0).alias("exact_match"), scored(R.f1_of(field, F.col("exact"), F.col("p"), F.col("g")), 0.0).alias("token_f1"), "review_required")


def _means(*columns: str) -> list[Column]:
    return [F.round(F.avg(F.col(c).cast("double")), 6).alias("review_required_rate" if c == "review_required" else c) for c in columns]


def branch_fields(detail: DataFrame) -> DataFrame:
    return detail.groupBy("branch", "field").agg(*_means("coverage", "exact_match", "token_f1", "review_required"), F.count("*").alias("n"))


def branch_table(detail: DataFrame, predicted: DataFrame, records: DataFrame, components: DataFrame, diagnostics: DataFrame, shown: list[str] = SHOWN) -> DataFrame:
    """One row a branch: means, rates of failure, components a record, and the exact matches of some fields as columns.

    `records` are all that count (record); `components` has record and kind; `diagnostics` record and fallback_used.
    """
    scores = detail.groupBy("branch").agg(*_means("coverage", "exact_match", "token_f1", "review_required"), *(F.round(F.avg(F.when(F.col("field") == f, F.col("exact_match"))), 6).alias(f"{f}_exact_match") for f in shown))
    rate = lambda s: F.round(F.avg((F.coalesce(F.col("status"), F.lit("")) == s).cast("double")), 6)
    ran = predicted.groupBy("branch").agg(F.count_distinct("record").alias("records"), rate("not_evaluated").alias("not_evaluated_rate"), rate("parse_failure").alias("parse_failure_rate"))
    counts = components.groupBy("record").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(IDENTIFIER_TYPES)).alias("identifiers"))
    fallen = diagnostics.groupBy("record").agg(F.max(R.truthy(F.col("fallback_used").cast("string")).cast("int")).alias("fallen"))
    per_record = records.select("record").distinct().join(counts, "record", "left").join(fallen, "record", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = per_record.agg(F.round(F.avg(zero("n")), 6).alias("component_count"), F.round(F.avg((zero("identifiers") > 0).cast("double")), 6).alias("identifier_component_recall_proxy"), F.round(F.avg(zero("fallen")), 6).alias("fallback_rate"))
    joined = ran.join(scores, "branch", "left").crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn("review_required_rate", F.coalesce("review_required_rate", F.lit(0.0)))


def overall(detail: DataFrame, outputs: DataFrame, barcodes: DataFrame, corrected: Column, reference: dict[str, float]) -> DataFrame:
    """One row over a whole run: pooled and filled-only means, parse success, barcodes, corrections, tokens, and what changed against reference values.

    `detail` has record, evaluable, coverage, exact_match, token_f1, unsupported, review_required and prediction; `outputs` one
    row a call with parsed, not_evaluated, tokens; `barcodes` record and barcode; `corrected` is a condition on outputs.
    """
    filled = lambda c: F.round(F.avg(F.when(T.clean(F.col("prediction")) != "", F.col(c).cast("double"))), 6)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    scores = detail.agg(
        F.count_distinct("record").alias("records"), F.sum("evaluable").cast("long").alias("evaluable_field_units"), *(mean(c).alias(c) for c in ("coverage", "exact_match", "token_f1")), filled("exact_match").alias("exact_match_among_filled"),
        filled("token_f1").alias("token_f1_among_filled"), filled("unsupported").alias("unsupported_prediction_rate"), filled("review_required").alias("review_required_rate"),
    )
    good = F.col("parsed") & ~F.col("not_evaluated")
    calls = outputs.agg(F.count_if(good).alias("parsed_records"), F.round(F.avg(good.cast("double")), 6).alias("parse_success_rate"), F.count_if(corrected).alias("taxonomy_corrections"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    decoded = barcodes.groupBy("record").agg(F.count_if(T.clean(F.col("barcode")) != "").alias("n")).agg(F.count("*").alias("barcode_records"), F.count_if(F.col("n") > 0).alias("barcode_records_with_values"), F.count_if(F.col("n") > 1).alias("barcode_ambiguous_records"))
    one = scores.crossJoin(calls).crossJoin(decoded)  # one row each
    return one.withColumns({f"{c}_delta": F.round(F.col(c) - v, 6) for c, v in reference.items()})


def paired_methods(detail: DataFrame) -> DataFrame:
    """One row: the first method that ends in _no_rag, and the first that ends in _rag otherwise (blank if there is none)."""
    control = F.col("method").endswith("_no_rag")
    tested = F.col("method").endswith("_rag") & ~control
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("method"))), F.lit(""))
    return detail.agg(first(control).alias("control"), first(tested).alias("tested"))


def method_delta(detail: DataFrame) -> DataFrame:
    """record, field, both scores and token_f1_delta of the paired methods; rows of both only."""
    pair = F.broadcast(paired_methods(detail))  # one row
    named = detail.crossJoin(pair)
    side = lambda which, name: named.filter(F.col("method") == F.col(which)).select("record", "field", F.col("exact_match").cast("double").alias(f"exact_match_{name}"), F.col("token_f1").cast("double").alias(f"token_f1_{name}"))
    both = side("control", "no_rag").join(side("tested", "rag"), ["record", "field"])
    return both.withColumn("token_f1_delta", F.round(F.col("token_f1_rag") - F.col("token_f1_no_rag"), 6))


def helped_and_hurt(delta: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` rows by record and field that gained, and those that did not, with `side`."""
    sided = delta.filter("token_f1_delta is not null").withColumn("side", F.when(F.col("token_f1_delta") > 0, "helped").otherwise("hurt"))
    return top_k(sided, "side", [F.col("record"), F.col("field")], most)


def verdict(detail: DataFrame) -> DataFrame:
    """One row: both methods, mean_delta, and in words what their comparison says, or why there is none."""
    rows = detail.crossJoin(F.broadcast(paired_methods(detail)))
    of = lambda which, c: F.when(F.col("method") == F.col(which), c)
    n = lambda which: F.count(of(which, F.lit(1)))
    all_of = lambda which, c: F.min(of(which, F.coalesce(F.col(c).cast("int"), F.lit(0)))) == 1
    some = lambda which: F.coalesce(F.sum(of(which, F.col("evaluable"))), F.lit(0)) > 0
    state = rows.agg(
        F.coalesce(F.first("control"), F.lit("")).alias("control"), F.coalesce(F.first("tested"), F.lit("")).alias("tested"), (n("control") > 0).alias("has_control"), (n("tested") > 0).alias("has_tested"),
        F.coalesce(all_of("control", "not_evaluated") & all_of("tested", "not_evaluated"), F.lit(False)).alias("unevaluated"), F.coalesce(all_of("control", "parse_failure") & all_of("tested", "parse_failure"), F.lit(False)).alias("unparsed"), (some("control") & some("tested")).alias("evaluable"),
    )
    mean = method_delta(detail).agg(F.round(F.avg("token_f1_delta"), 6).alias("mean_delta"))
    said = F.format_string("%.3f", F.abs("mean_delta"))
    words = (
        F.when(F.col("has_control") & ~F.col("has_tested"), "unavailable: only the control was run").when(~F.col("has_control") & F.col("has_tested"), "unavailable: the control was not run").when(~F.col("has_control"), "unavailable: neither method was run")
        .when(F.col("unevaluated"), "unavailable: neither method was evaluated").when(F.col("unparsed"), "unavailable: no output of either could be parsed").when(~F.col("evaluable"), "unavailable: the methods did not both give outputs to evaluate")
        .when(F.col("mean_delta").isNull(), "inconclusive: no comparable scores").when(F.col("mean_delta") > 0, F.concat(F.lit("improved mean token F1 by "), said)).when(F.col("mean_delta") < 0, F.concat(F.lit("reduced mean token F1 by "), said)).otherwise("no average difference")
    )
    return state.crossJoin(mean).select("control", "tested", "mean_delta", words.alias("verdict"))


def diagnostics(outputs: DataFrame, reports: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """(detail, summary): calls with what the last report on each says, and one row of counts over them.

    `outputs` has record, method, backend, raw_output, attempted, parse_failure, not_evaluated and not_evaluated_reason; `reports`
    record, method, endpoint_reachable, not_evaluated; of several on one call the one with the greatest `place` counts.
    """
    last = reports.groupBy("record", "method").agg(F.max_by(F.struct("endpoint_reachable", "not_evaluated"), place).alias("last"))
    flag = lambda c: R.truthy(F.col(c).cast("string"))
    joined = outputs.join(last, ["record", "method"], "left")
    detail = joined.select(
        "record", "method", "backend", (F.coalesce("raw_output", F.lit("")) != "").alias("raw_output_nonempty"), F.coalesce(F.length("raw_output"), F.lit(0)).cast("long").alias("raw_output_length"), F.when(F.col("attempted").isNull(), True).otherwise(flag("attempted")).alias("attempted"),
        flag("parse_failure").alias("parse_failure"), (flag("not_evaluated") | R.truthy(F.col("last.not_evaluated").cast("string"))).alias("not_evaluated"), F.coalesce("not_evaluated_reason", F.lit("")).alias("not_evaluated_reason"), R.truthy(F.col("last.endpoint_reachable").cast("string")).alias("endpoint_reachable"),
    )
    empty = ~F.col("raw_output_nonempty")
    failed = empty & F.col("endpoint_reachable") & (F.col("not_evaluated_reason") == "empty_raw_output")
    summary = detail.agg(
        F.array_join(F.array_sort(F.filter(F.collect_set("backend"), lambda x: x != "")), ", ").alias("backend"), F.count("*").alias("records"), F.count_if("attempted").alias("llm_calls_attempted"), F.count_if(~F.col("attempted")).alias("llm_calls_skipped"),
        F.count_if(~empty).alias("raw_output_nonempty"), F.count_if(empty).alias("empty_raw_outputs"), F.count_if(failed).alias("api_empty_responses"), F.round(F.count_if(failed) / F.greatest(F.count("*"), F.lit(1)), 6).alias("api_empty_response_rate"),
        F.count_if(~empty & ~F.col("parse_failure") & ~F.col("not_evaluated")).alias("parsed_records"), F.count_if("parse_failure").alias("parse_failures"), F.count_if("not_evaluated").alias("not_evaluated"), F.coalesce(F.bool_or("endpoint_reachable"), F.lit(False)).alias("endpoint_reachable"),
    )
    return detail, summary


def by_method(rows: DataFrame, methods: list[str]) -> DataFrame:
    """record, field, and a value_ and f1_ column for each method; `rows` has record, field, method, value, token_f1."""
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return rows.groupBy("record", "field").agg(*(of(m, c).alias(f"{n}_{m}") for m in methods for c, n in (("value", "value"), ("token_f1", "f1"))))


def canonical_scores(predicted: DataFrame, gold: DataFrame, fields: list[str], canonical: dict[str, str]) -> DataFrame:
    """method, field, n_evaluable, prediction_coverage, exact_match, token_f1; fields in `canonical` are judged by the column named there, if there is one."""
    column = lambda f: canonical[f] if canonical.get(f) in predicted.columns else f
    truth = gold.select("record", F.struct(*(F.col(f).alias(f) for f in fields)).alias("gold"))
    joined = predicted.select("record", "method", F.struct(*(F.col(column(f)).alias(f) for f in fields)).alias("pred")).join(truth, "record")
    rows = joined.select("method", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), T.normalize_eval(F.col(f"pred.{f}")).alias("p"), T.normalize_eval(F.col(f"gold.{f}")).alias("g"), (T.clean(F.col(f"pred.{f}")) != "").alias("there"), (T.clean(F.col(f"gold.{f}")) != "").alias("known")) for f in fields))))
    mean = lambda c: F.round(F.avg(F.when(F.col("known"), c)), 6)
    f1 = R.bag_f1(R.bag(F.col("p")), R.bag(F.col("g")))
    return rows.groupBy("method", "field").agg(F.count_if("known").alias("n_evaluable"), mean(F.col("there").cast("double")).alias("prediction_coverage"), mean((F.col("p") == F.col("g")).cast("double")).alias("exact_match"), mean(f1).alias("token_f1"))


def text_paths(components: DataFrame, most: int) -> DataFrame:
    """record, paths: the different files of text-bearing components, the surest first, up to `most`.

    `components` has record, kind, path and confidence (textual or number); files are told apart before they are ranked.
    """
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    held = components.select("record", T.clean(F.col("path")).alias("path"), sure.alias("sure"), "kind").filter((F.col("path") != "") & F.col("kind").isin(TEXT_TYPES))
    best = held.groupBy("record", "path").agg(F.max("sure").alias("sure"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("sure"), "path"))).filter(F.col("rank") <= most)
    return ranked.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def require_readings(readings: DataFrame, prefix: str, records: DataFrame | None = None) -> int:
    """How many readings of engines with the prefix have text; an error with up to five statuses if none has. One small aggregate."""
    own = readings.filter(F.startswith("engine", F.lit(prefix)))
    if records is not None:
        own = own.join(records.select("record").distinct(), "record", "left_semi")
    status = T.clean(F.col("status"))
    r = own.agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("good"), F.slice(F.array_sort(F.collect_set(F.when(status != "", status))), 1, 5).alias("statuses")).first()
    if not r["good"]:
        raise RuntimeError(f"evidence gate failed before extraction: {r['n']} attempts, 0 non-empty outputs; {'; '.join(r['statuses']) or 'no rows'}")
    return r["good"]


def prompt_digest(system: Column, prompt: Column) -> Column:
    """SHA-256 of the messages of a call as JSON with sorted keys and no blanks."""
    message = lambda role, text: F.to_json(F.struct(text.alias("content"), F.lit(role).alias("role")))
    return F.sha2(F.concat(F.lit("["), message("system", system), F.lit(","), message("user", prompt), F.lit("]")), 256)


def stratum_offset(name: Column) -> Column:
    """A number below 10000 from the digest of a stratum's name."""
    return (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % 10000).cast("int")


def extraction_rows(rule: DataFrame, answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Rule rows and model rows of one shape: record, method, the rule's or the answer's columns, and how the call went.

    `requests` has record, gate_reason (blank for calls that are made) and prompt_sha256; `answers` record, parsed, raw_output
    and the columns of `rule`. Records that were held back, or whose answer is blank or can't be parsed, have no values, and say why.
    """
    columns = [c for c in rule.columns if c not in ("record", "method")]
    joined = requests.join(answers, "record", "left")
    raw = T.clean(F.col("raw_output"))
    reason = F.when(F.col("gate_reason") != "", F.col("gate_reason")).when(raw == "", "empty_raw_output").otherwise("")
    failed = (reason == "") & ~F.coalesce(F.col("parsed"), F.lit(False))
    none = F.lit(None)
    model = joined.select("record", F.lit("model").alias("method"), *(F.when((reason == "") & ~failed, F.col(c)).otherwise(none).alias(c) for c in columns), (F.col("gate_reason") == "").alias("attempted"), (reason != "").alias("not_evaluated"), reason.alias("not_evaluated_reason"), failed.alias("parse_failure"), "prompt_sha256")
    rows = rule.select("record", "method", *columns, F.lit(False).alias("attempted"), F.lit(False).alias("not_evaluated"), F.lit("").alias("not_evaluated_reason"), F.lit(False).alias("parse_failure"), none.cast("string").alias("prompt_sha256"))
    return rows.unionByName(model)
