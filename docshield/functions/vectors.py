"""Vector Column builders (E2, V2, V3) and the hashing tokeniser's native form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the k rule (V2).
CLOUD_HOSTS = ["api.openai.com", "api.groq.com", "openrouter.ai", "api.anthropic.com", "api.cohere.ai"]
CLOUD_MODEL_MARKERS = ["gpt-", "claude-", "gemini-", "command-r", "meta-llama"]
K_CLOUD = 8
K_LOCAL = 4
K_SUGGEST = 3

HASH_DIM = 384
TOKEN_RE = r"[\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    """V3 core: sum of products as DOUBLE (vectors cast before multiplying)."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm2(v: Column) -> Column:
    return F.aggregate(v.cast("array<double>"), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_normalize(v: Column) -> Column:
    """V / ||v||; the zero vector stays zero."""
    n = F.sqrt(norm2(v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(
        F.transform(v.cast("array<double>"), lambda x: x / n))


def score(q: Column, v: Column) -> Column:
    """V3: dot product rounded to 4 digits."""
    return F.round(dot(q, v), 4)


def k_for(host: Column, model: Column) -> Column:
    """V2: 8 for cloud hosts or cloud model names (case-insensitive), else 4."""
    h, m = F.lower(F.coalesce(host, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    cloud = None
    for x in CLOUD_HOSTS:
        c = F.instr(h, x) > 0
        cloud = c if cloud is None else cloud | c
    for x in CLOUD_MODEL_MARKERS:
        cloud = cloud | (F.instr(m, x) > 0)
    return F.when(cloud, F.lit(K_CLOUD)).otherwise(F.lit(K_LOCAL))


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs: the hashing embedder's tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def bucket(token: Column, dim: int = HASH_DIM) -> Column:
    """md5-based feature-hash bucket (md5 so that the SQL oracle can repeat it)."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))
