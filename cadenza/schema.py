"""Record types of the data model, as Spark schemas, and constants that results depend on."""

from pyspark.sql import types as T

CLIP = T.StructType([
    T.StructField("audio_path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("duration", T.DoubleType()),
    T.StructField("channel", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("source", T.StringType()),
])
CLIP_COLUMNS = CLIP.fieldNames()
PREDICTION = "audio_file string, audio_path string, channel string, bucket string, duration double, ref string, hyp string"
METRICS = "struct<wer: double, cer: double, wer_legacy: double, cer_legacy: double, n: bigint>"
INTERVAL = "struct<start: double, end: double>"
TIMED_TEXT = "struct<start: double, end: double, text: string>"
RESULT = f"struct<text: string, segments: array<{TIMED_TEXT}>, audio_seconds: double, elapsed_seconds: double>"
ROW = "samples array<float>, text string, duration double, path string"

# Fixed values.
SAMPLE_RATE = 16_000
MIN_CLIP_S, MAX_CLIP_S = 0.5, 60.0
BUCKETS = ("0-5", "5-30", "30-60", "60+")
SPLITS = ("train", "val", "test")
CHANNEL_RATIOS, HASH_RATIOS = (0.8, 0.1, 0.1), (0.9, 0.05, 0.05)
MIN_CHANNELS = 3
FILES_PER_DIR = 1000
