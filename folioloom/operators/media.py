"""Argument lists for encoders, PNG headers and sizes; running encoders is not part of the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encoder arguments by target, and heights by resolution.
AUDIO = {
    "mp3": "-c:a libmp3lame -q:a 2", "wav": "-c:a pcm_s16le", "ogg": "-c:a libvorbis -q:a 4",
    "flac": "-c:a flac", "aac": "-c:a aac -b:a 192k", "m4a": "-c:a aac -b:a 192k",
}
VIDEO = ("mp4", "webm", "avi", "mov", "mkv")
HEIGHTS = {"1080p": 1080, "720p": 720, "480p": 480, "360p": 360}
GIF = "-vf fps=10,scale=480:-1:flags=lanczos -loop 0"


def media_args(source: Column, target: Column, name_in: Column, name_out: Column, crf: Column, resolution: Column, audio_rate: Column) -> Column:
    """Encoder arguments of a media conversion; null where the pair is none."""
    audio = F
    for t, args in AUDIO.items():
        audio = audio.when(target == t, args)
    audio = audio.otherwise(F.lit(None).cast("string"))
    scale = F
    for r, h in HEIGHTS.items():
        scale = scale.when(resolution == r, f"-vf scale=-2:{h} ")
    scale = scale.otherwise("")
    crf, rate = F.coalesce(crf, F.lit(23)).cast("string"), F.coalesce(audio_rate, F.lit("192k"))
    x264 = F.concat(scale, F.lit("-c:v libx264 -preset fast -crf "), crf)
    video = (
        F.when(target.isin("mp4", "mov", "mkv"), F.concat(x264, F.lit(" -c:a aac -b:a "), rate))
        .when(target == "webm", F.concat(scale, F.lit("-c:v libvpx-vp9 -crf "), crf, F.lit(" -b:v 0 -c:a libvorbis")))
        .when(target == "avi", F.concat(x264, F.lit(" -c:a mp3")))
    )
    is_audio, from_video = target.isin(*AUDIO), source.isin(*VIDEO)
    middle = (
        F.when(target == "gif", GIF).when(from_video & is_audio, F.concat(F.lit("-vn "), audio))
        .when(source.isin(*AUDIO) & is_audio, audio).when(from_video & target.isin(*VIDEO), video)
    )
    return F.concat(F.array(F.lit("-i"), name_in), F.split(middle, " "), F.array(name_out))


def png_size(data: Column) -> Column:
    """Width and height from the header; 800 by 400 for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    png = (F.length(data) >= 24) & (F.hex(F.substring(data, 1, 2)) == "8950")
    return F.struct(F.when(png, number(17)).otherwise(800).alias("width"), F.when(png, number(21)).otherwise(400).alias("height"))


def png_to_svg(data: Column) -> Column:
    size = png_size(data)
    w, h = size["width"].cast("string"), size["height"].cast("string")
    box = F.concat(F.lit('width="'), w, F.lit('" height="'), h, F.lit('"'))
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" '), box, F.lit('>\n  <image href="data:image/png;base64,'), F.regexp_replace(F.base64(data), "\\s", ""), F.lit('" '), box, F.lit("/>\n</svg>"))


def format_bytes(n: Column) -> Column:
    """Bytes in B, KB, MB or GB with at most one decimal, base 1024."""
    i = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(3)).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), i), 1)
    text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), i + 1)))


def format_bytes_sql(e: str) -> str:
    i = f"least(floor(ln({e}::DOUBLE) / ln(1024::DOUBLE) + 1e-12), 3)::INT"
    return f"(CASE WHEN {e} = 0 THEN '0 B' ELSE regexp_replace(round({e} / pow(1024::DOUBLE, {i}), 1)::VARCHAR, '\\.0$', '') || ' ' || ['B','KB','MB','GB'][{i} + 1] END)"
