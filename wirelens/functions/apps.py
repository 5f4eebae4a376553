"""Application classes, labels and the default host keyword classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import _col

# --- fixed values (must equal the reference for identical results) ---------
# Enum names of the application classes, in declaration order.
APP_NAMES = [
    "UNKNOWN", "HTTP", "HTTPS", "DNS",
    "YOUTUBE", "FACEBOOK", "GOOGLE", "TWITTER",
    "NETFLIX", "TIKTOK", "GITHUB", "AMAZON",
]
# Display labels of the branded classes; the others display as their name.
APP_LABELS = {
    "YOUTUBE": "YouTube",
    "FACEBOOK": "Facebook",
    "GOOGLE": "Google",
    "TWITTER": "Twitter",
    "NETFLIX": "Netflix",
    "TIKTOK": "TikTok",
    "GITHUB": "GitHub",
    "AMAZON": "Amazon",
}
# Host keywords per class, tested as lower-case substrings; the first class
# (in this order) with a matching keyword wins.
DEFAULT_KEYWORDS = [
    ("YOUTUBE", ["youtube", "ytimg", "googlevideo"]),
    ("FACEBOOK", ["facebook", "fbcdn", "instagram"]),
    ("GOOGLE", ["google", "googleapis", "gstatic"]),
    ("TWITTER", ["twitter", "twimg"]),
    ("NETFLIX", ["netflix", "nflxvideo"]),
    ("TIKTOK", ["tiktok", "tiktokcdn"]),
    ("GITHUB", ["github"]),
    ("AMAZON", ["amazon", "amazonaws"]),
]
# Port fallback on the (normalised or service) destination port.
PORT_APPS = [(443, "HTTPS"), (80, "HTTP"), (53, "DNS")]
# ---------------------------------------------------------------------------


def label_of(name: str) -> str:
    return APP_LABELS.get(name, name)


ALL_LABELS = [label_of(n) for n in APP_NAMES]


def app_label(name_col) -> Column:
    """Enum name (any case) -> display label; unknown names pass through."""
    c = F.upper(_col(name_col))
    out = None
    for name, label in APP_LABELS.items():
        out = (F.when(c == name, F.lit(label)) if out is None
               else out.when(c == name, F.lit(label)))
    return out.otherwise(_col(name_col))


def keyword_rows() -> list[tuple[int, str, str]]:
    """The default keyword table as ``(priority, keyword, app label)`` rows."""
    rows = []
    for prio, (name, kws) in enumerate(DEFAULT_KEYWORDS):
        for kw in kws:
            rows.append((prio, kw, label_of(name)))
    return rows


def named_app(host) -> Column:
    """Keyword class label of a host, NULL when nothing matches.

    NULL or empty hosts never match.
    """
    h = F.lower(_col(host))
    out = None
    for name, kws in DEFAULT_KEYWORDS:
        cond = None
        for kw in kws:
            t = h.contains(kw)
            cond = t if cond is None else (cond | t)
        lab = F.lit(label_of(name))
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return F.when(F.length(_col(host)) > 0, out)


def port_app(port) -> Column:
    """Port fallback class."""
    p = _col(port)
    out = None
    for num, lab in PORT_APPS:
        out = (F.when(p == num, F.lit(lab)) if out is None
               else out.when(p == num, F.lit(lab)))
    return out.otherwise(F.lit("UNKNOWN"))


def classify(host, port) -> Column:
    """Keyword class, else port class."""
    return F.coalesce(named_app(host), port_app(port))
