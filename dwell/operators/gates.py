"""Whitelist gates (P6, P7).  They check the *schema* only, so they cost no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


class LeakageError(AssertionError):
    pass


def check_columns(columns: Sequence[str], allowed: Sequence[str], forbidden: Sequence[str],
                  required: Sequence[str] = ()) -> None:
    """Order of complaints: forbidden first, then unlisted, then missing."""
    present = [c for c in forbidden if c in columns]
    if present:
        raise LeakageError(f"forbidden columns present: {present}")
    extra = [c for c in columns if c not in set(allowed)]
    if extra:
        raise LeakageError(f"columns outside the whitelist: {extra}")
    missing = [c for c in required if c not in columns]
    if missing:
        raise LeakageError(f"required columns missing: {missing}")


def select_stored(df: DataFrame, stored: Sequence[str], forbidden: Sequence[str],
                  working: Sequence[str] = ()) -> DataFrame:
    """Project to the stored columns.  Working columns are named and dropped; a forbidden
    column stops the run, then any other column that is in neither list, then a missing one."""
    check_columns(df.columns, [*stored, *working], forbidden, required=stored)
    return df.select(*stored)


def feature_matrix(df: DataFrame, allowed: Sequence[str], forbidden: Sequence[str] = (),
                   passthrough: Sequence[str] = ()) -> DataFrame:
    """The features in fixed order (plus named pass-through columns)."""
    present = [c for c in forbidden if c in df.columns]
    if present:
        raise LeakageError(f"forbidden columns present: {present}")
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise LeakageError(f"required columns missing: {missing}")
    return df.select(*passthrough, *allowed)
