"""Errors of renders: hints by signature, and failures worth a retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures in their order (lower-case parts of a message), with a code and a hint.
SIGNATURES = (
    ("disk_full", ("no space left on device", "enospc"), "The disk is full; free some space or choose another folder."),
    ("missing_file", ("no such file or directory", "enoent", "could not open file", "unable to open"), "The source file is missing or has moved; add it again."),
    ("no_permission", ("permission denied", "eacces", "operation not permitted"), "The file or folder may not be read or written; check its permissions."),
    ("no_streams", ("does not contain any stream", "output file does not contain any stream"), "The clip has no usable picture or sound; export it again."),
    ("no_video", ("does not contain any image", "no video stream", "video stream not found"), "The clip has no video track."),
    ("no_audio", ("stream map", "matches no streams", "audio stream not found", "no audio"), "The clip has no audio track."),
    (
        "codec",
        ("decoder not found", "encoder not found", "not found for input stream", "unknown codec", "codec not currently supported", "unsupported codec", "could not find codec parameters"),
        "The clip has a format that can't be read; export it as H.264 in MP4.",
    ),
    ("damaged", ("moov atom not found", "truncat", "invalid nal", "corrupt"), "The clip looks damaged or cut off; export or fetch it again."),
    ("invalid_data", ("invalid data found when processing input", "invalid data found"), "The clip can't be read; it may be damaged or in an unknown format."),
)
GENERIC = "The clip could not be processed; export it as H.264 in MP4 and try again."
#: Messages of an exhausted graphics card, as they are written.
GPU = ("OpenEncodeSessionEx failed", "No capable devices found", "Cannot load nvcuda.dll", "out of memory")


def code(raw: Column) -> Column:
    """Code of the first signature that the message holds, or ``generic``."""
    text, out = F.lower(F.coalesce(raw, F.lit(""))), None
    for name, parts, _ in SIGNATURES:
        hit = text.contains(parts[0])
        for p in parts[1:]:
            hit = hit | text.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def classify(raw: Column, prefix: str | None = None) -> Column:
    """Hint for a message; a prefix is put before hints of known signatures only."""
    found, out = code(raw), None
    for name, _, hint in SIGNATURES:
        text = f"{prefix}: {hint}" if prefix else hint
        out = F.when(found == name, text) if out is None else out.when(found == name, text)
    return out.otherwise(GENERIC)


def is_gpu_session(raw: Column) -> Column:
    hit = F.lit(False)
    for g in GPU:
        hit = hit | F.coalesce(raw, F.lit("")).contains(g)
    return hit
