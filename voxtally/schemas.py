"""Schemas of the data model: chunks, task events, conditions, manifests."""

from pyspark.sql import types as T

#: One block of voxels of an image file. ``voxels`` is column-major (x varies
#: fastest), as in the file. ``block`` numbers the z-slabs of a file that is
#: read in several pieces; a file that fits in one piece has block 0 only.
#: The array's element type depends on the file, hence the factory.
def chunk_schema(element: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("image", T.StringType()),
            T.StructField("x0", T.IntegerType()),
            T.StructField("y0", T.IntegerType()),
            T.StructField("z0", T.IntegerType()),
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("dtype", T.StringType()),
            T.StructField("affine", T.ArrayType(T.DoubleType())),
            T.StructField("header", T.BinaryType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("n_blocks", T.IntegerType()),
            T.StructField("voxels", T.ArrayType(element)),
        ]
    )


# Experiment numbers and delays mix integer and decimal literals in the JSON.
CONDITION = T.StructType(
    [
        T.StructField("experiment", T.DoubleType()),
        T.StructField("framework", T.StringType()),
        T.StructField("filesystem", T.StringType()),
        T.StructField("delay", T.DoubleType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("iterations", T.IntegerType()),
    ]
)

COPIED = T.StructType(
    [
        T.StructField("out_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("node", T.StringType()),
        T.StructField("executor", T.LongType()),
    ]
)
