"""Status to default label (1 = default)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from loantriad.functions.parsing import cut

# Status words of the source tables. Arabic yeh and kaf, literal match;
# one accepted value carries two spaces.
GOOD_STATUSES = (
    "فعال",
    "پرداخت شده كامل",
    "ضمانت نامه صادر شده",
    "خاتمه عادي",
    "اعطاء كامل",
    "اعطاء  ناقص",
    "باطل شده",
    "جاري",
)
DEFAULT_STATUSES = (
    "ابطال مصوبه ضمانت نامه",
    "درخواست رد شده",
    "منقضي شده",
    "معوق",
    "مشكوك الوصول",
    "سررسيدشده پرداخت نشده",
    "سررسيد گذشته",
    "وثيقه ناقص",
)
DEFAULT_STATUSES_SHORT = ("مشكوك الوصول", "معوق", "سررسيد گذشته")


def label_from_good(status: Column, good: Iterable[str] = GOOD_STATUSES) -> Column:
    """0 for a trimmed status in ``good``; everything else, NULL included, is a default."""
    return F.when(status.isNull(), 1).when(cut(status).isin(list(good)), 0).otherwise(1)


def label_from_default(status: Column, default: Iterable[str] = DEFAULT_STATUSES) -> Column:
    """1 for a status in ``default`` (no trim); NULL is 0."""
    return F.coalesce(status.isin(list(default)), F.lit(False)).cast("int")


def label_from_count(events: Column) -> Column:
    """1 when there was at least one default event; an unknown count is 0."""
    return F.coalesce(events > 0, F.lit(False)).cast("int")
