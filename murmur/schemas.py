"""Schemas of the transcript tables."""

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("conf", T.DoubleType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("word", T.StringType())])
MESSAGE = T.StructType([T.StructField("data", T.StructType([T.StructField("result", T.ArrayType(WORD)), T.StructField("text", T.StringType())])), T.StructField("silence", T.BooleanType())])
SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("speaker", T.StringType())])
SENTENCE = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())])
RAW_DATA = T.MapType(T.StringType(), T.ArrayType(MESSAGE))
STREAM_ROW = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("ts", T.TimestampType())])
BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
