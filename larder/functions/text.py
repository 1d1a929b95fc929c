"""Column functions on text, JSON, ids and timestamps."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.scalars import _col

# These must equal the application's own.
SENSITIVE_KEYS = ("access_token", "refresh_token")
LANGUAGES = ("en", "es", "fr", "ja", "ko", "pt")
PLACEHOLDER = "\u200b"
REDACTED = "[REDACTED]"
SECRET_VALUE = r"=(['\"]?)([^'\"\s,)}]+)\1"
DEDUP_KEY_LENGTH = 64
PARTICIPANT_ID_LENGTH = 24
PROBABLE_SECONDS_BELOW = 100_000_000_000
TITLE_LENGTH = 20
DEFAULT_TITLE = "New Chat"


def humanise(col: Column | str) -> Column:
    """``TRANSPORT_DELAY`` → ``transport delay``."""
    return F.lower(F.regexp_replace(_col(col), "_", " "))


def duration_seconds(text: Column | str) -> Column:
    """``5``, ``5s``, ``5.5s`` and ``500ms`` as seconds; anything else is NULL."""
    text = F.trim(_col(text))
    number = F.regexp_extract(text, r"^([\d.]+)(ms|s)?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([\d.]+)(ms|s)?$", 2)
    return F.when(unit == "ms", number / F.lit(1000.0)).otherwise(number)


def from_epoch_ms(ms: Column | str) -> Column:
    """Epoch milliseconds as a timestamp; missing stays NULL, so results do not depend on the clock."""
    return F.timestamp_millis(_col(ms).try_cast("bigint"))


def probably_seconds(ms: Column | str) -> Column:
    """Flags an epoch too small to be milliseconds."""
    return _col(ms) < F.lit(PROBABLE_SECONDS_BELOW)


def language_of(locale: Column | str, supported: Sequence[str] = LANGUAGES, default: str = "en") -> Column:
    head = F.lower(F.regexp_extract(_col(locale), r"^([^-_]*)", 1))
    return F.when(head.isin(*supported), head).otherwise(F.lit(default))


def dedup_key(namespace: str, *parts: Column | str) -> Column:
    """SHA-256 hex of the namespace and the parts, NUL between them.

    Where parts are missing, a last line says which, so that a missing part is neither an empty one nor a shifted one.
    """
    texts = [_col(p).cast("string") for p in parts]
    raw = F.concat_ws("\u0000", F.lit(namespace), *[F.coalesce(t, F.lit("")) for t in texts])
    absent = F.concat(*[F.when(t.isNull(), F.lit("1")).otherwise(F.lit("0")) for t in texts]) if texts else F.lit("")
    raw = F.when(absent.contains("1"), F.concat(raw, F.lit("\u0000\n"), absent)).otherwise(raw)
    return F.substring(F.sha2(raw, 256), 1, DEDUP_KEY_LENGTH)


def encode_segment(col: Column | str) -> Column:
    """Percent-encode one path segment; unreserved marks stay, a space is ``%20``."""
    encoded = F.url_encode(_col(col))
    for form, path in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        encoded = F.regexp_replace(encoded, form, path)
    return encoded


def chat_title(text: Column | str) -> Column:
    """First characters of the first message, or a default where it is blank."""
    text = _col(text)
    head = F.regexp_replace(F.substring(text, 1, TITLE_LENGTH), r"^\s+|\s+$", "")
    return F.when(text.rlike(r"\S"), head).otherwise(F.lit(DEFAULT_TITLE))


def word_count(text: Column | str) -> Column:
    """Words between white space, counted without building an array of them."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"\S+")), F.lit(0))


def redact_text(col: Column | str, keys: Sequence[str] = SENSITIVE_KEYS) -> Column:
    """Blank the value in ``key=value``, quoted or not, whatever the case of the key."""
    out = _col(col)
    for key in keys:
        out = F.regexp_replace(out, f"(?i){re.escape(key)}{SECRET_VALUE}", f"{key}=$1{REDACTED}$1")
    return out


def redact_json(col: Column | str, keys: Sequence[str] = SENSITIVE_KEYS) -> Column:
    """Blank the values of sensitive keys at any depth of a JSON text, whatever they hold; all else stays as it is.

    Key names are matched exactly, escapes decoded. Where the value of such a key is not JSON, the text is cut there.
    Values nest, which no regular expression of the engine can follow, so texts that name a key are read in Python,
    batch by batch; all others stay in the engine.
    """
    secret = frozenset(keys)

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _without_secrets(t, secret))

    col = _col(col)
    # A key may be written with escapes, so a backslash is reason enough to look.
    named = col.contains("\\")
    for key in keys:
        named = named | col.contains(key)
    return F.when(named, blank(F.when(named, col))).otherwise(col)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_COLON = re.compile(r"\s*:\s*")


def _without_secrets(text: str, keys: frozenset[str]) -> str:
    read = json.JSONDecoder().raw_decode
    out, at, done = [], 0, 0
    while (name := _STRING.search(text, at)) is not None:
        at = name.end()
        colon = _COLON.match(text, at)
        if colon is None:
            continue
        try:
            key = json.loads(name[0], strict=False)
        except ValueError:
            key = name[0][1:-1]
        at = colon.end()
        if key not in keys:
            continue
        out.append(text[done:at] + f'"{REDACTED}"')
        try:
            at = done = read(text, at)[1]
        except (ValueError, RecursionError):
            return "".join(out)
    return "".join(out) + text[done:]


def extras_text(extras: Column | str) -> Column:
    """A map column as ``k=v | k=v``, keys in order."""
    entries = F.array_sort(F.map_entries(_col(extras)))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))),
        " | ",
    )


def error_text(code: Column | str, message: Column | str) -> Column:
    code, message = _col(code), _col(message)
    present = code.isNotNull() & (code != "")
    return F.when(present, F.concat(F.lit("["), code, F.lit("] "), message)).otherwise(message)


def first_text(json_col: Column | str) -> Column:
    """``content`` of a JSON object, else ``text``; blank counts as missing."""

    def field(name):
        return F.get_json_object(_col(json_col), f"$.{name}")

    content, text = field("content"), field("text")
    chosen = F.when(content.isNotNull() & (content != ""), content).otherwise(text)
    trimmed = F.regexp_replace(chosen, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def _uuid_sha256(uuid: Column | str) -> Column:
    return F.sha2(F.unhex(F.replace(_col(uuid), F.lit("-"), F.lit(""))), 256)


def synthetic_id(uuid: Column | str) -> Column:
    """Positive 31-bit number from a UUID. Two UUIDs may share one: check with ``duplicate_keys``."""
    head = F.conv(F.substring(_uuid_sha256(uuid), 1, 8), 16, 10).cast("bigint")
    return F.greatest(head.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")), F.lit(1).cast("bigint"))


def participant_id(raw: Column | str, uuid: Column | str) -> Column:
    """A given 24-hex id, normalised; else 24 hex characters derived from the UUID."""
    given = F.lower(F.trim(_col(raw)))
    valid = given.rlike(rf"^[0-9a-f]{{{PARTICIPANT_ID_LENGTH}}}$")
    return F.when(valid, given).otherwise(F.substring(_uuid_sha256(uuid), 1, PARTICIPANT_ID_LENGTH))


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text with ``Z`` or an offset as a timestamp; missing or malformed is NULL."""
    return _col(text).try_cast("timestamp")


def strip_placeholder(col: Column | str) -> Column:
    """Stored zero-width placeholder and NULL both become the empty text."""
    return F.coalesce(F.nullif(_col(col), F.lit(PLACEHOLDER)), F.lit(""))


def add_placeholder(col: Column | str) -> Column:
    """Empty or missing text as the stored placeholder."""
    return F.coalesce(F.nullif(_col(col), F.lit("")), F.lit(PLACEHOLDER))


def display_role(role: Column | str) -> Column:
    role = _col(role)
    return F.when(role.isin("developer", "tool", "activity"), F.lit("system")).otherwise(role)
