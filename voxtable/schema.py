"""Table schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VOXEL_KEY = ["case_id", "z", "y", "x"]

CASES = T.StructType([
    T.StructField("case_id", T.StringType(), False),
    T.StructField("sz", T.DoubleType()),
    T.StructField("sy", T.DoubleType()),
    T.StructField("sx", T.DoubleType()),
    T.StructField("nz", T.IntegerType()),
    T.StructField("ny", T.IntegerType()),
    T.StructField("nx", T.IntegerType()),
])

SLICES = T.StructType([
    T.StructField("case_id", T.StringType(), False),
    T.StructField("volume", T.StringType(), False),
    T.StructField("z", T.IntegerType(), False),
    T.StructField("ny", T.IntegerType(), False),
    T.StructField("nx", T.IntegerType(), False),
    T.StructField("cells", T.ArrayType(T.IntegerType()), False),
])

# Column names of the annotation file.
FILE_ID = "图像清洗后编码"
LAYER = "标记所在层面"
AXIAL = "左右肺整体轴向分布"
MANIFESTATION = "左右肺整体征象"
LESION = "异常征象"

ANNOTATION_REQUIRED = [FILE_ID, LAYER, AXIAL, MANIFESTATION]
ANNOTATIONS = T.StructType([
    T.StructField(FILE_ID, T.StringType()),
    T.StructField(LAYER, T.DoubleType()),
    T.StructField(AXIAL, T.StringType()),
    T.StructField(MANIFESTATION, T.StringType()),
    T.StructField(LESION, T.StringType()),
])

CASE_RECORDS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("disease_pattern", T.StringType()),
    T.StructField("overall_axial_distribution", T.StringType()),
    T.StructField("overall_manifestation", T.StringType()),
    T.StructField("abnormal_manifestation_presence", T.ArrayType(T.IntegerType())),
    T.StructField("roi_layers", T.ArrayType(T.IntegerType())),
    T.StructField("roi_axial_distributions", T.ArrayType(T.StringType())),
    T.StructField("roi_manifestations", T.ArrayType(T.StringType())),
])

RUN_STEPS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("failed", T.BooleanType()),
])

# Axial terms of the annotation file and their English names.
AXIAL_TERMS = {
    "外周": "peripheral",
    "中心": "central",
    "弥漫/散在": "diffuse_scattered",
    "弥漫分布": "diffuse",
    "外周分布-胸膜下": "peripheral_subpleural",
    "外周分布-其他": "peripheral_other",
    "外周胸膜下省略+中心": "peripheral_subpleural_central",
    "中心分布": "central",
}

# Manifestation terms and their English names.
MANIFESTATION_TERMS = {
    "胸膜下": "subpleural",
    "胸膜下省略": "subpleural_omitted",
    "GGO实变不区分": "ggo_consolidation_mixed",
    "其他": "other",
}

# Lesion terms, in the order of the presence vector.
LESION_TERMS = {"蜂窝": "honeycombing", "网格": "reticulation", "实变": "consolidation", "GGO": "ggo"}

# Lesion label ids of the analysis volumes.
ANALYSIS_LABELS = {1: "honeycomb", 2: "reticulation", 3: "ground_glass_opacity", 4: "consolidation"}

# Label ids of the training slices, after the shift by one, with caption synonyms.
TRAINING_LABELS = {
    1: ("normal", ["normal", "healthy lung"]),
    2: ("GGO", ["ground glass opacity", "GGO"]),
    3: ("reticulation", ["reticulation", "reticular pattern"]),
    4: ("consolidation", ["consolidation", "airspace consolidation"]),
    5: ("honeycombing", ["honeycombing", "honeycomb pattern"]),
}
TRAINING_LESIONS = [2, 3, 4, 5]

# The default relabelling of raw label volumes.
RELABELLING = {3: 2, 4: 3, 5: 4}

LABEL_DIM = T.StructType([
    T.StructField("scheme", T.StringType(), False),
    T.StructField("label_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("synonyms", T.ArrayType(T.StringType()), False),
])


def label_dim(spark: SparkSession) -> DataFrame:
    """Both label schemes as one dimension table of nine rows."""
    rows = [("analysis", key, name, [name]) for key, name in ANALYSIS_LABELS.items()]
    rows += [("training", key, name, synonyms) for key, (name, synonyms) in TRAINING_LABELS.items()]
    return spark.createDataFrame(rows, LABEL_DIM)


def term_dim(spark: SparkSession) -> DataFrame:
    """Annotation terms and their English names, one row per (attribute, term)."""
    rows = [("axial", term, name) for term, name in AXIAL_TERMS.items()]
    rows += [("manifestation", term, name) for term, name in MANIFESTATION_TERMS.items()]
    rows += [("lesion", term, name) for term, name in LESION_TERMS.items()]
    return spark.createDataFrame(rows, "attribute string, term string, name string")
