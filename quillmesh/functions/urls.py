"""URL normalisation, by column expressions with a vectorised step only where percent-coding needs it."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Query keys that only track.
TRACKING_KEYS = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid mc_cid mc_eid".split()
)


def clean_url(url: str | None) -> str | None:
    """An http(s) URL without fragment, default port and tracking keys, host in lower case, query sorted; else None."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    host = parts.hostname.lower()
    if port and port != {"http": 80, "https": 443}[scheme]:
        host = f"{host}:{port}"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING_KEYS)
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._")
    return f"{scheme}://{host}{path}" + (f"?{urlencode(pairs)}" if pairs else "")


@pandas_udf(T.StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return url.map(clean_url, na_action=None)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
