"""Seals, validation rules, manifests, run comparison and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions.canonical import canonical_json  # noqa: F401  part of this module's interface
from pairlight.functions.dims import SYSTEM
from pairlight.functions.scoring import grammar_score, strict_score

SEAL = r',"record_sha256":"[0-9a-f]{64}"'


def seal(body: Column) -> Column:
    return F.sha2(body, 256)


def sealed_line_ok(line: Column) -> Column:
    """A stored JSON line, judged as it stands: its seal is the hash of the line without the seal."""
    return F.regexp_extract(line, r'"record_sha256":"([0-9a-f]{64})"', 1) == F.sha2(F.regexp_replace(F.regexp_replace(line, SEAL, ""), r'^\{"record_sha256":"[0-9a-f]{64}",', "{"), 256)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that can't be judged counts as broken.

    No higher-order function takes the rules: its argument would be interpreted, and what they share judged anew by each.
    """
    return F.array_except(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items())), F.array(F.lit(None).cast("string")))


def rendered(prompt: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def ids_json(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ","), F.lit("]"))


def output_rules(version: int = 1, eos: int = 2, cap: int = 64, vocabulary: int | None = None, seconds: float = 18_000) -> dict[str, Column]:
    """The rules of an output row. Version 1 doesn't bind end-of-sequence and truncation; 2 and 3 do."""
    c = F.col
    if version == 1:
        scored = strict_score(c("completion"), c("answer"), c("truncated"))
    else:
        scored = grammar_score(c("completion"), c("expression"), c("answer"), c("format"), c("truncated"))
    rules = {f"score_{k}": c(k).eqNullSafe(v) for k, v in scored.items() if k != "parsed_digits"}
    rules |= {
        "prompt_hash": c("rendered_prompt_sha256") == F.sha2(c("rendered_prompt"), 256),
        "token_hash": c("input_token_sha256") == F.sha2(ids_json(c("input_token_ids")), 256),
        "input_count": c("input_tokens") == F.size("input_token_ids"),
        "output_count": c("output_tokens") == F.size("output_token_ids"),
        "timing": (c("elapsed_seconds") >= 0) & (c("elapsed_seconds") < seconds),
    }
    if version > 1:
        top = vocabulary if vocabulary is not None else 2**31 - 1
        rules |= {
            "template": c("rendered_prompt") == rendered(c("prompt")),
            "token_range": F.forall(F.concat("input_token_ids", "output_token_ids"), lambda t: (t >= 0) & (t < top)),
            "output_length": (c("output_tokens") > 0) & (c("output_tokens") <= cap),
            "eos": c("ended_with_eos") == (F.element_at("output_token_ids", -1) == eos),
            "truncation": c("truncated") == ((c("output_tokens") == cap) & ~c("ended_with_eos")),
            "finished": c("ended_with_eos") | c("truncated"),
        }
    return rules


def compare(left: DataFrame, right: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``left``: whether ``right`` has it, and which columns differ; nulls are equal."""
    columns = [c for c in left.columns if c != key and c not in exclude]
    other = right.select(F.col(key), F.lit(True).alias("__there"), *(F.col(c).alias(f"__{c}") for c in columns))
    differing = F.array_compact(F.array(*(F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(None)).otherwise(F.lit(c)) for c in columns)))
    joined = left.join(other, key, "left")
    return joined.select(key, F.coalesce("__there", F.lit(False)).alias("found"), F.when(F.col("__there"), differing).alias("differing"))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, problem: files that are missing or whose bytes or hash differ."""
    seen = files.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("h") != F.col("sha256"), "hash")
    return manifest.join(seen, "name", "left").select("name", problem.alias("problem"))


def tree_check(manifest: DataFrame, files: DataFrame, barred: tuple[str, ...] = (".safetensors", ".bin", ".whl", ".log"), most_bytes: int = 10 << 20) -> DataFrame:
    """name, problem of a tree (name, bytes, sha256) against its manifest, both ways; null where a file is as it should be.

    Problems in this order: missing, extra, barred (by suffix), large, size, hash. A name that a side holds twice meets
    each row of the other. Null names equal each other; a null size or hash equals null alone.
    """
    want = manifest.select(F.col("name").alias("w_name"), F.col("bytes").alias("w_bytes"), F.col("sha256").alias("w_sha"), F.lit(True).alias("w"))
    seen = files.select(F.col("name").alias("s_name"), F.col("bytes").alias("s_bytes"), F.col("sha256").alias("s_sha"), F.lit(True).alias("s"))
    c = F.col
    suffix = F.lit(False)
    for end in barred:
        suffix = suffix | c("s_name").endswith(end)
    problem = (
        F.when(c("s").isNull(), "missing").when(c("w").isNull(), "extra").when(suffix, "barred").when(c("s_bytes") > most_bytes, "large")
        .when(~c("s_bytes").eqNullSafe(c("w_bytes")), "size").when(~c("s_sha").eqNullSafe(c("w_sha")), "hash")
    )
    return want.join(seen, c("w_name").eqNullSafe(c("s_name")), "full").select(F.coalesce("w_name", "s_name").alias("name"), problem.alias("problem"))


def audit(stored: DataFrame, expected: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row: records, expected, missing, unexpected, broken, whether they form a prefix, complete."""
    both = expected.select(key, F.col("ordinal").alias("e")).join(stored.withColumn("v", F.size(violations(rules))).select(key, F.lit(1).alias("s"), "v"), key, "full")
    counts = both.agg(F.count("s").alias("records"), F.count("e").alias("expected"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.coalesce(F.sum(F.when(F.col("v") > 0, 1)), F.lit(0)).alias("broken"), F.max(F.when(F.col("s").isNotNull(), F.col("e"))).alias("last"))
    return counts.select("records", "expected", "missing", "unexpected", "broken", F.coalesce(F.col("last") + 1 == F.col("records"), F.lit(True)).alias("prefix"), ((F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("broken") == 0)).alias("complete"))


def audit_inputs(stored: DataFrame, made: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """One row: records, expected, missing, unexpected, changed, complete. ``made`` are the inputs made anew; one join judges both sides.

    A key that a side holds more than once counts each of its rows; it is changed unless both sides have the same digests
    as often (judged by the sum of their 64-bit hashes).
    """
    side = lambda d, p: d.groupBy(*keys).agg(F.count("*").alias(f"{p}n"), F.sum(F.xxhash64(digest).cast("decimal(38,0)")).alias(f"{p}sum")).select(*(F.col(k).alias(f"{p}{k}") for k in keys), f"{p}n", f"{p}sum")
    met = [F.col(f"s_{k}").eqNullSafe(F.col(f"m_{k}")) for k in keys]
    both = side(stored, "s_").join(side(made, "m_"), met, "full")
    c = F.col
    same = (c("s_n") == c("m_n")) & (c("s_sum") == c("m_sum"))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0))
    counts = both.agg(total(c("s_n")).alias("records"), total(c("m_n")).alias("expected"), total(F.when(c("s_n").isNull(), c("m_n"))).alias("missing"), total(F.when(c("m_n").isNull(), c("s_n"))).alias("unexpected"), total(F.when(c("s_n").isNotNull() & c("m_n").isNotNull() & ~same, c("s_n"))).alias("changed"))
    return counts.withColumn("complete", (c("records") == c("expected")) & (c("missing") + c("unexpected") + c("changed") == 0))


def tree_limits(files: DataFrame, most_files: int = 1000, most_bytes: int = 10 << 20, most_total: int = 32 << 20) -> DataFrame:
    """One row of totals against their limits."""
    n, total, largest = F.count("*"), F.sum("bytes"), F.max("bytes")
    return files.agg(n.alias("files"), total.alias("total_bytes"), largest.alias("largest"), ((n <= most_files) & (largest <= most_bytes) & (total <= most_total)).alias("within"))
