"""Lenient JSON replies and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("collaboration", "co-mention", "wrong")
CONFIDENCE = ("high", "medium", "low")
REPLY = "label string, confidence string, reasoning string"


def reply(c, check: bool = True, labels=LABELS, confidence=CONFIDENCE) -> Column:
    """A model's reply: thinking blocks go, then what stands from the first brace to the last is read. check: null where label or confidence is none of the known."""
    x = F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    r = F.from_json(F.regexp_extract(x, r"(?s)(\{.*\})", 1), REPLY)
    ok = r["label"].isin(*labels) & (r["confidence"].isNull() | r["confidence"].isin(*confidence)) if check else r["label"].isNotNull()
    return F.when(ok, r)


def cost(prompt, cached, completion, price_in, price_cached, price_out) -> Column:
    """Price of a call, from prices for a million tokens."""
    return F.round(((prompt - cached) * price_in + cached * price_cached + completion * price_out) / 1e6, 6)


def density(edges, nodes) -> Column:
    return F.try_divide(edges, nodes * (nodes - 1))


def percent(part, whole) -> Column:
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), 2), F.lit(0.0))


def pair_id(*parts) -> Column:
    return F.concat_ws("__", *parts)
