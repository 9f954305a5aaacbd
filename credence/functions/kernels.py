"""Numeric kernels as Column functions: vectors, confidence (sigma) and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7
DAY = 86400


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(wide(a), F.lit(1), n), F.slice(wide(b), F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(wide(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return F.transform(wide(v), lambda x: x / length)


def bhattacharyya(mu_a: Column, sig_a: Column, mu_b: Column, sig_b: Column) -> Column:
    """Distance of two diagonal Gaussians given as arrays."""
    delta = F.zip_with(wide(mu_a), wide(mu_b), lambda x, y: (x - y) * (x - y))
    mean = F.zip_with(wide(sig_a), wide(sig_b), lambda x, y: (x + y) / 2 + EPS)
    geo = F.zip_with(wide(sig_a), wide(sig_b), lambda x, y: F.sqrt(x * y) + EPS)
    add = lambda s, x: s + x
    return F.aggregate(F.zip_with(delta, mean, lambda d, m: d / m), F.lit(0.0), add) / 8 + F.aggregate(F.zip_with(mean, geo, lambda m, g: F.log(m / g)), F.lit(0.0), add) / 2


def same_mean_distance(a: Column, b: Column, dims: int) -> Column:
    """The same for equal means and one sigma for all dimensions: it depends on the ratio only."""
    return dims / 2 * F.log(((a + b) / 2 + EPS) / (F.sqrt(a * b) + EPS))


def kalman(mu_a: Column, sig_a: Column, mu_b: Column, sig_b: Column) -> tuple[Column, Column]:
    """Precision-weighted mean and combined sigma, element by element."""
    precision = lambda s: F.transform(wide(s), lambda x: 1 / F.greatest(x, F.lit(1e-9)))
    total = F.zip_with(precision(sig_a), precision(sig_b), lambda x, y: x + y)
    weighted = F.zip_with(F.zip_with(wide(mu_a), precision(sig_a), lambda m, p: m * p), F.zip_with(wide(mu_b), precision(sig_b), lambda m, p: m * p), lambda x, y: x + y)
    return F.zip_with(weighted, total, lambda w, t: w / t), F.transform(total, lambda t: 1 / t)


def kalman_sigma(a: Column, b: Column) -> Column:
    return 1 / (1 / F.greatest(a, F.lit(1e-9)) + 1 / F.greatest(b, F.lit(1e-9)))


def should_merge(distance: Column, threshold: float = 0.15) -> Column:
    return distance < threshold


def sharpen(sigma: Column, contradicted: Column = None, domain_size: Column = None, factor: float = 0.85) -> Column:
    """Confidence after being retrieved: narrower down to a floor by domain size, wider if contradicted."""
    size = F.lit(10) if domain_size is None else domain_size
    floor = F.when(size < 5, 0.35).when(size < 15, 0.25).otherwise(0.15)
    narrower = F.greatest(factor * sigma, floor)
    return narrower if contradicted is None else F.when(contradicted, F.least(1.2 * sigma, F.lit(1.5))).otherwise(narrower)


def decay(sigma: Column, delta: Column | float = 0.02) -> Column:
    return sigma + delta


def initial_sigma(intensity: Column) -> Column:
    return 0.5 * F.when(intensity > 0.7, 0.5).when(intensity > 0.4, 0.75).otherwise(1.0)


def distributional_score(cos: Column, sigma_q: Column, sigma_m: Column) -> Column:
    """Overlap of the query's and the row's distribution; 0.5 where a sigma is no positive number."""
    mean = (sigma_q + sigma_m) / 2
    value = F.exp(-(2 * (1 - F.greatest(cos, F.lit(0.0))) / mean / 8 + F.log(mean / F.sqrt(sigma_q * sigma_m)) / 2))
    fine = (sigma_q > 0) & (sigma_m > 0) & ~F.isnan(sigma_q) & ~F.isnan(sigma_m) & ~F.isnan(cos)
    return F.when(fine, value).otherwise(0.5)


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / DAY


def recency(last_accessed: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - age_days(last_accessed, now) / 90)


def access_frequency(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / math.log(51))


def damped_cosine(cos: Column, sigma_m: Column, sigma_q: Column) -> Column:
    return cos * F.greatest(F.lit(0.75), 1 - 0.25 * F.greatest(F.lit(0.0), sigma_m - sigma_q))


def temporal_boost(ts: Column, days: int | None, now: Column) -> Column:
    if days is None:
        return F.lit(0.0)
    off = F.abs(age_days(ts, now) - days)
    return F.when(off <= 2, 0.35 * (1 - off / 2)).otherwise(0.0)


def base_score(cos, bm25, rec, acc, entity, rrf, cohesion, temporal) -> Column:
    """Weights: similarity .50, keywords .15, recency .27, access .08; the boosts are bounded."""
    return (
        0.50 * cos + 0.15 * bm25 + 0.27 * rec + 0.08 * acc + F.least(entity, F.lit(0.25)) + F.least(6 * rrf, F.lit(0.1))
        + F.when(cos >= 0.4, cohesion).otherwise(0.0) + temporal
    )


def session_length_penalty(kind: Column, text: Column) -> Column:
    n = F.char_length(text)
    return F.when((kind == "session") & (n > 500), F.least(F.lit(0.15), 0.04 * F.log2(n / 500))).otherwise(0.0)


def primary_score(base: Column, penalty: Column, overlap: Column) -> Column:
    return base * (1 - penalty) * F.least(F.lit(1.40), F.greatest(F.lit(0.70), 0.70 + 0.70 * overlap))


def freshness(ts: Column, now: Column) -> Column:
    return F.least(F.lit(0.10), F.greatest(F.lit(0.0), 0.10 * (1 - age_days(ts, now) / 2)))


def activation(primary, neighbours, sigma, contradiction, same_domain, session, fresh, file_edit) -> Column:
    spread = 0.4 * neighbours * F.greatest(F.lit(0.0), 1 - sigma) * F.when(contradiction, 0.3).otherwise(1.0)
    return (primary + spread + F.when(same_domain, 0.05).otherwise(0.0) + session + fresh) * F.when(file_edit, 0.55).otherwise(1.0)


def query_sigma(text: str, entities: int) -> float:
    return min(0.8, max(0.2, 0.3 + 0.5 * min(len(text) / 300, 1) + (-0.1 * min(entities, 2) if entities else 0.05)))


def pool_size(top_k: int, sigma_q: float) -> int:
    share = min(1.0, max(0.0, (sigma_q - 0.2) / 0.6))
    return min(50, top_k * (4 + math.floor(4 * share + 0.5)))


def cohesion(shared: Column) -> Column:
    """From the sum over a row's entities of (members - 1) / log2(max(2, members))."""
    return F.least(F.lit(0.10), 0.03 * shared)


def entity_boost(shared: Column) -> Column:
    return F.least(F.lit(0.2), 0.1 * shared)


def effective_delta(n: Column, idle_days: Column, delta: float = 0.02) -> Column:
    """Decay step: slower for rows often read, threefold for rows never read within a week."""
    return delta / (1 + F.log(n + 1)) * F.when((n == 0) & (idle_days > 7), 3.0).otherwise(1.0)


def trajectory(sigma: Column, n: Column) -> Column:
    """Interpolated history from 0.5 to sigma in n steps."""
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.round(0.5 - (0.5 - sigma) * i / n, 4))


def cooldown_seconds(now: Column) -> Column:
    """Seconds to the next UTC midnight, a minute at least."""
    return F.greatest(F.lit(60), DAY - F.unix_timestamp(now) % DAY)


def mean(values: Column) -> Column:
    return F.aggregate(wide(values), F.lit(0.0), lambda s, x: s + x) / F.size(values)


def unpack_sigma(encoded: list[str | None]):
    """Base64 little-endian float32 arrays; corrupt ones become [1.0]."""
    import base64

    import numpy as np

    out = []
    for e in encoded:
        try:
            raw = base64.b64decode(e or "", validate=True)
            out.append(np.frombuffer(raw, "<f4").tolist() if raw and len(raw) % 4 == 0 else [1.0])
        except ValueError:
            out.append([1.0])
    return out


def pack_sigma(values: list[float]) -> str:
    import base64

    import numpy as np

    return base64.b64encode(np.asarray(values, "<f4").tobytes()).decode()
