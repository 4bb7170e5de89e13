"""Configuration objects and the fixed labels that results carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

# Tolerance, decimals and labels that every result must show exactly.
EPSILON = 1e-6
AMOUNT_DECIMALS = 6
CENTS = 100

STATUS_RECONCILED = "01_Conciliado"
STATUS_DIFFERENT = "02_Encontrado c/Diferença"
STATUS_NOT_FOUND = "03_Não Encontrado"
STATUS_NOT_EVALUATED = "04_Não Avaliado"

GROUP_RECONCILED = "Conciliado"
GROUP_IMMATERIAL = "Diferença Imaterial"
GROUP_NOT_FOUND = "Não encontrado"
GROUP_A_LARGER = "Encontrado com diferença, BASE A MAIOR"
GROUP_B_LARGER = "Encontrado com diferença, BASE B MAIOR"
GROUP_REVERSED = "Conciliado_Estorno"
GROUP_REVERSED_DOCS = "Documentos estornados"
GROUP_CANCELLED = "NF Cancelada"

OVERWRITE = "OVERWRITE"
ONLY_EMPTY = "ONLY_EMPTY"

KIND_A = "CONTABIL"
KIND_B = "FISCAL"

# Columns that value clean-up and attribution write-back never touch.
RESERVED_COLUMNS = ("id", "created_at", "updated_at")

ROW_ID = "row_id"


def _columns(cols: Sequence[str] | str) -> tuple[str, ...]:
    return (cols,) if isinstance(cols, str) else tuple(cols)


@dataclass(frozen=True)
class KeyDef:
    """One composite key; the position in a key list is its priority."""

    key_id: str
    cols_a: Sequence[str]
    cols_b: Sequence[str]

    def __post_init__(self) -> None:
        object.__setattr__(self, "cols_a", _columns(self.cols_a))
        object.__setattr__(self, "cols_b", _columns(self.cols_b))
        if not self.cols_a or not self.cols_b:
            raise ValueError(f"key {self.key_id} needs at least one column on each side")


def build_keys(
    cols_a: Mapping[str, Sequence[str]], cols_b: Mapping[str, Sequence[str]]
) -> list[KeyDef]:
    """Key list from per-side column maps.

    A key without columns for B borrows those of A; a key without columns for A is left out.
    """
    return [
        KeyDef(key_id, cols, cols_b.get(key_id) or cols)
        for key_id, cols in cols_a.items()
        if cols
    ]


@dataclass(frozen=True)
class GroupConfig:
    """Single-key comparison of sums."""

    key_cols_a: Sequence[str]
    key_cols_b: Sequence[str]
    value_a: str
    value_b: str
    invert: bool = False
    limit: float = 0.0


@dataclass(frozen=True)
class RowConfig:
    """Prioritised multi-key comparison, one output row per input row."""

    keys: Sequence[KeyDef]
    value_a: str
    value_b: str
    invert: bool = False
    limit: float = 0.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        if not self.keys:
            raise ValueError("at least one key is needed")
        ids = [k.key_id for k in self.keys]
        if len(set(ids)) != len(ids):
            raise ValueError("key ids must be distinct")


@dataclass(frozen=True)
class ReversalConfig:
    """Document column, reference column, amount column and tolerance of a reversal.

    By default rows reverse each other in pairs; ``zero_sum_groups`` reverses all rows of a key whose
    amounts sum to zero.
    """

    col_a: str
    col_b: str
    value: str
    limit: float = 0.0
    zero_sum_groups: bool = False

    def __post_init__(self) -> None:
        if not self.limit >= 0:
            raise ValueError("limit must be zero or more")


@dataclass(frozen=True)
class CancelConfig:
    """Indicator column and the value that means cancelled.

    ``relaxed`` compares without case and surrounding blanks, as the documentation describes;
    the default is the exact comparison.
    """

    column: str
    value: str = "S"
    relaxed: bool = False


@dataclass(frozen=True)
class AttributionKey:
    key_id: str
    origin_cols: Sequence[str]
    dest_cols: Sequence[str]

    def __post_init__(self) -> None:
        object.__setattr__(self, "origin_cols", _columns(self.origin_cols))
        object.__setattr__(self, "dest_cols", _columns(self.dest_cols))

    @property
    def pairs(self) -> list[tuple[str, str]]:
        """(destination, origin) columns, up to the shorter of the two lists."""
        return list(zip(self.dest_cols, self.origin_cols))


@dataclass(frozen=True)
class AttributionConfig:
    """Columns to copy from an origin table to a destination table.

    ``origin`` and ``dest`` optionally name the two tables and their kinds, so that a run of a
    table onto itself, or between tables of the same kind, is refused.
    """

    keys: Sequence[AttributionKey]
    selected: Sequence[str]
    mode: str = OVERWRITE
    clean_keys: bool = False
    origin: tuple[str, str] | None = None
    dest: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "selected", tuple(self.selected))
        if not self.keys:
            raise ValueError("at least one key is needed")
        if self.mode not in (OVERWRITE, ONLY_EMPTY):
            raise ValueError(f"unknown write mode: {self.mode}")
        if (self.origin is None) != (self.dest is None):
            raise ValueError("name both tables or neither")
        if self.origin is not None and self.dest is not None:
            if self.origin[0] == self.dest[0]:
                raise ValueError("origin and destination must differ")
            if {self.origin[1], self.dest[1]} != {KIND_A, KIND_B}:
                raise ValueError("origin and destination must be of opposite kinds")
