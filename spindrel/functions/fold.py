"""Text folding that Catalyst has no function for, as Arrow batches."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def fold_array(values: pa.Array) -> pa.Array:
    """NFKC, lower case, NFKC again; then letters and digits only. Nulls stay null."""
    out = pc.utf8_normalize(pc.utf8_lower(pc.utf8_normalize(values, form="NFKC")), form="NFKC")
    return pc.replace_substring_regex(out, pattern=r"[^\p{L}\p{N}]+", replacement="")


@F.pandas_udf(StringType())
def fold(values: pd.Series) -> pd.Series:
    """Letters and digits of each text in order, without letter case and Unicode form."""
    return fold_array(pa.Array.from_pandas(values, type=pa.string())).to_pandas()


@F.pandas_udf(ArrayType(StringType()))
def fold_each(values: pd.Series) -> pd.Series:
    """`fold` over every element of an array column. A null array stays null, a null element too."""
    lists = pa.Array.from_pandas(values, type=pa.list_(pa.string()))
    flat = fold_array(lists.flatten())
    out = pa.ListArray.from_arrays(_offsets(lists), flat)
    return pd.Series([None if x is None else list(x) for x in out.to_pandas()]).where(~values.isna(), None)


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))])
