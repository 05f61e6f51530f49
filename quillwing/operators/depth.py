"""Values of recursive records under a type that ends somewhere."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa


def null_beyond(kind: pa.DataType) -> Callable[[Any], Any] | None:
    """What makes a decoded value fit a type in which recursion ends with null: whatever lies deeper becomes null. None where the type has no null."""
    if pa.types.is_null(kind):
        return lambda v: None
    if pa.types.is_struct(kind):
        inner = [(f.name, cut) for f in (kind.field(i) for i in range(kind.num_fields)) if (cut := null_beyond(f.type))]
        return (lambda v: None if v is None else v | {n: cut(v.get(n)) for n, cut in inner}) if inner else None
    if pa.types.is_map(kind):
        value = null_beyond(kind.item_type)
        return (lambda v: None if v is None else [(k, value(x)) for k, x in v]) if value else None
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        item = null_beyond(kind.value_type)
        return (lambda v: None if v is None else [item(x) for x in v]) if item else None
    return None


def fitted(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column of decoded values, with null beyond the depth of the type."""
    cut = null_beyond(kind)
    return pa.array(values if cut is None else [cut(v) for v in values], kind)
