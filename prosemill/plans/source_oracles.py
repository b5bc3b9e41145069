"""DuckDB SQL for the queries over sources, lookups and events."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..sources import readers
from .oracles import WORDS

_SKIP = "(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in sorted(readers._SKIP))
_LINE = "(?i)</(?:" + "|".join(sorted(readers._LINE)) + ")\\s*>"
_SUFFIX = "lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1))"
_FORMAT = "CASE " + " ".join(f"WHEN {_SUFFIX} IN ({', '.join(repr(s) for s in ss)}) THEN '{f}'" for f, ss in reversed(readers.FORMATS.items())) + " ELSE 'text' END"

TABLE = {
    "page_text_native": f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_SKIP}', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '{_LINE}', chr(10), 'g'), '<[^>]*>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages""",
    "supported_formats": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', {str(s in readers.REVIEWABLE).lower()})" for f, ss in readers.FORMATS.items() for s in ss) + ") AS t(suffix, format, reviewable)",
    "url_formats": f"SELECT page_id, {_FORMAT} AS format, {_SUFFIX} IN ({', '.join(repr(s) for s in readers.REVIEWABLE)}) AS reviewable FROM pages",
    "protected_words": f"SELECT word, n, domain FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w) JOIN (VALUES " + ", ".join(f"('{w}', '{d}')" for w, d in V.PROTECTED_TERMS.items()) + ") AS t(word, domain) USING (word)",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY ALL",
}
