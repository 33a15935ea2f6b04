"""Pattern scans of text by line, and path rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kinds of findings in text lines.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github_token": r"gh[oprsu]_[A-Za-z0-9]{20,}",
    "huggingface_token": r"hf_[A-Za-z0-9]{20,}",
    "openai_key": r"sk-[A-Za-z0-9_-]{20,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{20,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "windows_user_path": r"(?i)[A-Z]:[\\/]+Users[\\/]+[^<%\\/][^\\/]*[\\/]",
}
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "license": r"(?i)license"}


def scan_lines(df: DataFrame, *, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """``key, line, kind`` of every finding, lines from 1; the matched text is never returned. Texts with NUL are skipped."""
    rows = df.filter(F.col(text).isNotNull() & (F.instr(F.col(text), "\0") == 0))
    any_of = F.lit(False)
    for p in patterns.values():
        any_of = any_of | F.col(text).rlike(p)
    lines = rows.filter(any_of).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line_text"))
    kinds = F.array_compact(F.array(*[F.when(F.col("line_text").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return lines.select(key, (F.col("i") + 1).alias("line"), F.explode(kinds).alias("kind"))


def path_audit(paths: DataFrame, *, path: str, required: Sequence[str], denied: Sequence[str], excepted: Sequence[str] = ()) -> DataFrame:
    """``rule, entry`` of required entries without a path and of paths that are denied; an entry ending in ``/`` is a prefix."""

    def covered(entries: Sequence[str]):
        out = F.lit(False)
        for e in entries:
            out = out | (F.startswith(F.col(path), F.lit(e)) if e.endswith("/") else F.col(path) == e)
        return out

    bad = paths.filter(covered(denied) & ~covered(excepted)).select(F.lit("denied").alias("rule"), F.col(path).alias("entry"))
    flags = paths.agg(*[F.coalesce(F.bool_or(covered([e])), F.lit(False)).alias(f"e{i}") for i, e in enumerate(required)]) if required else None
    if flags is None:
        return bad
    entries = F.inline(F.array(*[F.struct(F.lit("missing").alias("rule"), F.lit(e).alias("entry"), F.col(f"e{i}").alias("found")) for i, e in enumerate(required)]))
    return bad.unionByName(flags.select(entries).filter("NOT found").drop("found"))
