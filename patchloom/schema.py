"""The data model: two explicit input schemas and the result schemas.

occurrence  one row per element of a patch, duplicates allowed; x and y are null without locations
incidence   distinct (patch_id, hash)
patch       all patches, empty ones too, with their input position `slot`
"""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
OCCURRENCE = T.StructType([T.StructField("patch_id", T.LongType(), False), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType(), False), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
NESTED = T.StructType([T.StructField("patch_id", T.LongType(), False), T.StructField("occ", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
SELECTION = T.StructType([T.StructField(c, T.LongType(), False) for c in ("step", "patch_id", "gain", "covered")])
STATS = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n_patches", T.LongType()), T.StructField("rep", POINT)])
