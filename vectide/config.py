"""Declared properties of a vector table: size, metric, storage type and index parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

# Limits and names that existing callers rely on.
MAX_DIMS = 8192
MAX_K = 4096
METRICS = {
    "l2": "l2", "l2sq": "l2", "euclidean": "l2",
    "cosine": "cosine", "cos": "cosine",
    "ip": "ip", "dot": "ip", "inner_product": "ip",
    "l1": "l1", "taxicab": "l1", "manhattan": "l1",
    "hamming": "hamming",
    "jaccard": "jaccard",
}
ALLOWED = {
    "float32": ("l2", "cosine", "ip", "l1", "hamming", "jaccard"),
    "int8": ("l2", "cosine", "ip", "l1"),
    "bit": ("hamming", "jaccard"),
}


def metric_name(name: str) -> str:
    """The metric an alias stands for; ``l2sq`` is the rooted distance too."""
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"vec0: unknown metric '{name}'") from None


def check_metric(metric: str, kind: str) -> str:
    """The metric's own name, if the storage type has it."""
    own = metric_name(metric)
    if kind not in ALLOWED:
        raise ValueError(f"vec0: unknown type '{kind}'")
    if own not in ALLOWED[kind]:
        raise ValueError(f"vec0: metric '{metric}' not supported for type '{kind}'")
    return own


@dataclass(frozen=True)
class VecConfig:
    """Options of a table. Unknown options and values out of range are errors."""

    dims: int
    metric: str = "cosine"
    type: str = "float32"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 10

    def __post_init__(self) -> None:
        if not 1 <= self.dims <= MAX_DIMS:
            raise ValueError(f"vec0: dims must be between 1 and {MAX_DIMS}")
        object.__setattr__(self, "metric", check_metric(self.metric, self.type))
        if self.m < 2:
            raise ValueError("vec0: m must be at least 2")
        if min(self.ef_construction, self.ef_search) < 1:
            raise ValueError("vec0: ef_construction and ef_search must be at least 1")

    @classmethod
    def parse(cls, *options: str) -> VecConfig:
        """From ``key=value`` strings, as a table declaration lists them."""
        known = {f.name: f.type for f in fields(cls)}
        values: dict[str, object] = {}
        for option in options:
            key, eq, value = (x.strip() for x in option.partition("="))
            if not eq or key not in known:
                raise ValueError(f"vec0: unknown option '{option.strip()}'")
            values[key] = int(value) if known[key] == "int" else value
        if "dims" not in values:
            raise ValueError("vec0: dims is required")
        return cls(**values)

    def rows(self) -> list[tuple[str, str]]:
        """(key, value) rows of the declaration."""
        return [(k, str(v)) for k, v in asdict(self).items()]


def check_ef(ef: object, default: int) -> int:
    """The beam of a search: a positive whole number, else the table's own."""
    return ef if isinstance(ef, int) and not isinstance(ef, bool) and ef > 0 else default


def check_k(k: int | None, ef_search: int) -> int:
    """How many neighbours a query returns: k, or ``ef_search`` where k is absent or not positive."""
    if k is not None and k > MAX_K:
        raise ValueError(f"vec0: LIMIT must be <= {MAX_K}")
    return k if k and k > 0 else ef_search
