"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two points given by column prefixes, e.g. ``src_`` and ``dst_``."""
    return F.sqrt(sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "xyz"), F.lit(0.0)))


def draw(*keys) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone and that any SQL engine with md5 can repeat."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed(*keys) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone: for draws by the thousand million, where md5 takes the time."""
    return F.shiftrightunsigned(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), 11) / F.lit(float(1 << 53))


def side(soma: str, root: str) -> Column:
    """Body side L, R or M where known, else root side L or R, else 'unknown'."""
    return F.coalesce(F.when(F.col(soma).isin("L", "R", "M"), F.col(soma)), F.when(F.col(root).isin("L", "R"), F.col(root)), F.lit("unknown"))


def node_label(cell_type: str, side_col: str) -> Column:
    return F.concat_ws("|", cell_type, side_col)


def voxels_to_micrometers(value: Column) -> Column:
    return value * 8 / 1000


def point(array: str, scale: float = 0.008) -> list[Column]:
    """x, y, z of a position array; null where the array is."""
    return [(F.col(array)[i] * F.lit(scale)).alias(k) for i, k in enumerate("xyz")]


def quantize(value: Column, low: Column, high: Column, levels: int = 65535) -> Column:
    """Affine map of [low, high] to 0..levels, rounded half to even and clipped; an empty span gives 0."""
    span = high - low
    return F.when(span == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(levels), F.bround((value - low) / span * levels).cast("int"))))


def split_side(name: Column) -> tuple[Column, Column]:
    """Stem and side of names that end in (L) or (R); null where they don't."""
    pattern = r"^(.*)\(([LR])\)$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))


def segment(name: Column) -> Column:
    """The first T1, T2 or T3 in a name."""
    return F.nullif(F.regexp_extract(name, r"T[123]", 0), F.lit(""))


def format_p(p: Column, draws: int) -> Column:
    """Wording of an empirical p-value, whose least value is 1 / (draws + 1)."""
    return F.when(p.isNull(), "n/a").when(p <= 1.0 / (draws + 1), F.lit(f"<= {1.0 / (draws + 1):.4f}")).otherwise(F.format_number(p, 4))


def direction(rho: Column, flat: float = 0.1) -> Column:
    return F.when(F.abs(rho) < flat, "flat").when(rho > 0, "rising").otherwise("falling")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
