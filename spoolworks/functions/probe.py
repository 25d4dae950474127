"""What a probe document says about a clip: rates, rotation, size, duration, colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
VFR_ANSWERABLE = ["mov", "mp4", "m4a", "3gp", "3g2", "mj2"]
HDR_TRANSFERS = ["arib-std-b67", "smpte2084"]
HDR_PRIMARIES = ["bt2020"]
NO_VIDEO, NO_DURATION, NOT_JSON, NO_SIZE = (
    "no video stream",
    "no duration",
    "not a probe document",
    "no frame size",
)

STREAM = T.StructType(
    [
        T.StructField("codec_type", T.StringType()),
        T.StructField("codec_name", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("r_frame_rate", T.StringType()),
        T.StructField("avg_frame_rate", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("side_data_list", T.ArrayType(T.StructType([T.StructField("rotation", T.DoubleType())]))),
        T.StructField("tags", T.StructType([T.StructField("rotate", T.StringType())])),
        T.StructField("sample_rate", T.StringType()),
        T.StructField("color_primaries", T.StringType()),
        T.StructField("color_transfer", T.StringType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("streams", T.ArrayType(STREAM)),
        T.StructField("format", T.StructType([T.StructField("format_name", T.StringType()), T.StructField("duration", T.StringType())])),
    ]
)


def number(text: Column) -> Column:
    """A finite decimal number with an optional exponent as double, else null: try_cast also takes suffixes like `1d`."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def rational(text: Column) -> Column:
    """`30000/1001` as a double; null for anything but number/number with a positive top and a bottom other than 0."""
    top, bottom = number(F.substring_index(text, "/", 1)), number(F.regexp_extract(text, r"(?s)^[^/]*/(.*)$", 1))
    return F.when(text.contains("/") & (bottom != 0) & (top > 0), top / bottom)


def variable_rate(format_name: Column, nominal: Column, average: Column) -> Column:
    """Whether the rate varies; null if the container can't tell or either rate is unknown."""
    can_tell = F.arrays_overlap(F.transform(F.split(F.lower(format_name), ","), lambda p: F.trim(p)), F.array(*[F.lit(x) for x in VFR_ANSWERABLE]))
    return F.when(can_tell & rational(nominal).isNotNull() & rational(average).isNotNull(), rational(nominal) != rational(average))


def quarter_turns(degrees: Column) -> Column:
    """Whole degrees in 0 to 359."""
    return F.pmod(degrees.cast("int"), F.lit(360))


def rotation(side_data: Column, tag: Column) -> Column:
    """The first rotation of the side data, else the legacy tag, else 0."""
    first = F.try_element_at(F.filter(side_data, lambda s: s["rotation"].isNotNull()), F.lit(1))["rotation"]
    return F.coalesce(quarter_turns(first), quarter_turns(number(tag)), F.lit(0))


def display_size(width: Column, height: Column, turned: Column) -> Column:
    """struct(width, height) as shown: swapped on a quarter turn."""
    across = turned.isin(90, 270)
    return F.struct(F.when(across, height).otherwise(width).alias("width"), F.when(across, width).otherwise(height).alias("height"))


def positive(*candidates: Column) -> Column:
    """The first candidate that is a number above 0."""
    return F.coalesce(*[F.when(number(c) > 0, number(c)) for c in candidates])


def colour_tag(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_hdr(transfer: Column, primaries: Column) -> Column:
    """Whether the colour tags say high dynamic range; null tags say no."""
    return F.lower(F.trim(F.coalesce(transfer, F.lit("")))).isin(HDR_TRANSFERS) | F.lower(F.trim(F.coalesce(primaries, F.lit("")))).isin(HDR_PRIMARIES)


def parsed(document: Column) -> Column:
    """A probe document (JSON text) as a struct of properties; reject_reason is null for a usable clip."""
    doc = F.from_json(document, DOCUMENT)
    valid = F.get_json_object(document, "$.streams").isNotNull() | F.get_json_object(document, "$.format").isNotNull()
    video = F.try_element_at(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    audio = F.try_element_at(F.filter(doc["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1))
    turned = rotation(video["side_data_list"], video["tags"]["rotate"])
    size = display_size(video["width"], video["height"], turned)
    duration = positive(doc["format"]["duration"], video["duration"])
    reason = (
        F.when(~F.coalesce(valid, F.lit(False)), NOT_JSON)
        .when(video.isNull(), NO_VIDEO)
        .when(F.coalesce(video["width"], F.lit(0)) * F.coalesce(video["height"], F.lit(0)) <= 0, NO_SIZE)
        .when(duration.isNull(), NO_DURATION)
    )
    return F.struct(
        doc["format"]["format_name"].alias("container_format"),
        duration.alias("duration_seconds"),
        size["width"].alias("display_width"),
        size["height"].alias("display_height"),
        turned.alias("rotation_degrees"),
        F.coalesce(rational(video["avg_frame_rate"]), rational(video["r_frame_rate"])).alias("fps_source"),
        variable_rate(doc["format"]["format_name"], video["r_frame_rate"], video["avg_frame_rate"]).alias("is_variable_frame_rate"),
        video["codec_name"].alias("video_codec"),
        audio["codec_name"].alias("audio_codec"),
        number(audio["sample_rate"]).cast("int").alias("audio_sample_rate"),
        colour_tag(video["color_primaries"]).alias("color_primaries"),
        colour_tag(video["color_transfer"]).alias("color_transfer"),
        is_hdr(video["color_transfer"], video["color_primaries"]).alias("is_hdr"),
        reason.alias("reject_reason"),
    )
