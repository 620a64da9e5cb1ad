"""Confidence calibration, fallbacks, document types and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _logit(x: Column) -> Column:
    return F.ln(x / (1 - x + 1e-8))


def temperature_scaled(confidence: Column, temperature: float) -> Column:
    return F.when(confidence <= 0, 0.0).otherwise(_unit(1 / (1 + F.exp(-_logit(confidence) / temperature))))


def platt_scaled(confidence: Column, a: float, b: float) -> Column:
    return F.when(confidence <= 0, 0.0).otherwise(_unit(1 / (1 + F.exp(-(a * _logit(confidence) + b)))))


def adjusted(confidence: Column, multiplier: Column, bias: Column) -> Column:
    """Brand adjustment: scaled, shifted, clamped."""
    return _unit(confidence * multiplier + bias)


def is_uncertain(confidence: Column, agreement: Column, threshold: float = 0.6) -> Column:
    return (confidence < threshold) | (agreement < 0.7) | ((confidence < 0.8) & (agreement < 0.8))


def document_type(text_share: Column, font_share: Column, image_share: Column, layout_share: Column) -> Column:
    """Born digital, scanned or hybrid by four weighted shares of evidence; nothing clear is unknown."""
    score = 0.3 * text_share + 0.25 * font_share + 0.2 * (1 - image_share) + 0.25 * layout_share
    return F.when(score >= 0.7, "born_digital").when(score <= 0.3, "scanned").when(score.between(0.4, 0.6), "hybrid").otherwise("unknown")


def quality_level(digital: Column, ocr: Column, issues: Column) -> Column:
    return F.when(digital & (issues == 0), "gold").when((ocr >= 0.95) & (issues <= 2), "silver").when(ocr >= 0.8, "bronze").otherwise("rejected")


def pdf_date(text: Column) -> Column:
    """A timestamp from D:YYYYMMDDHHmmSS with trailing parts optional; the zone is not kept."""
    digits = F.rpad(F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1), 14, "x")
    part = lambda at, n, default: F.when(F.substring(digits, at, n).rlike("^[0-9]+$"), F.substring(digits, at, n)).otherwise(default)
    stamp = F.concat(part(1, 4, "0000"), F.lit("-"), part(5, 2, "01"), F.lit("-"), part(7, 2, "01"), F.lit(" "), part(9, 2, "00"), F.lit(":"), part(11, 2, "00"), F.lit(":"), part(13, 2, "00"))
    return F.when(text.rlike(r"^(?:D:)?\d{4}"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))


def ocr_quality(wer: Column, cer: Column) -> Column:
    return F.when((wer <= 0.001) & (cer <= 0.001), "excellent").when(wer <= 0.02, "good").when(wer <= 0.05, "acceptable").when(wer <= 0.1, "poor").otherwise("failed")


def xmp_date(text: Column) -> Column:
    """A timestamp from ISO text with an optional zone, which is not kept."""
    return F.try_to_timestamp(F.replace(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
