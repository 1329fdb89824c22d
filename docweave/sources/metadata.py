"""Source kind, checked source metadata and URL normalisation."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from docweave.functions import text as tx

SOURCE_KINDS = ("file", "web", "image", "log")
WEB_SUFFIX_IMAGE = r"\.(png|jpg|jpeg)$"
LOG_ENCODINGS = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "gb18030")
LOG_NEWLINES = ("crlf", "lf", "cr", "mixed", "none")
SHA256 = "^[0-9a-f]{64}$"
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})$"
MAX_SAFE_INTEGER = 2 ** 53 - 1


def source_type(metadata, content_type, filename) -> Column:
    """web or log by the metadata kind, then image by MIME type or suffix, else file."""
    raw = F.coalesce(tx.as_column(metadata), F.lit(""))
    image = (F.lower(F.coalesce(tx.as_column(content_type), F.lit(""))).startswith("image/")
             | F.lower(F.coalesce(tx.as_column(filename), F.lit(""))).rlike(WEB_SUFFIX_IMAGE))

    def kind(name: str) -> Column:
        return raw.contains(f'"kind": "{name}"') | raw.contains(f'"kind":"{name}"')

    return F.when(kind("web"), "web").when(kind("log"), "log").when(image, "image").otherwise("file")


def _field(document: Column, name: str, kind: str) -> Column:
    """Field value only when its JSON type is exactly the expected one."""
    value = F.variant_get(document, f"$.{name}", "variant")
    kinds = {"string": ["STRING"], "bigint": ["BIGINT"], "array<string>": ["ARRAY<STRING>", "ARRAY<VOID>"]}[kind]
    return F.when(F.schema_of_variant(value).isin(kinds), F.try_variant_get(document, f"$.{name}", kind))


def parse_source_metadata(raw) -> Column:
    """Struct of the metadata, or NULL as soon as any field is invalid."""
    document = F.try_parse_json(tx.as_column(raw))
    kind = _field(document, "kind", "string")
    sha = _field(document, "sha256", "string")
    common = (_field(document, "format", "bigint") == 1) & sha.rlike(SHA256)
    url, title = _field(document, "url", "string"), _field(document, "title", "string")
    fetched, status = _field(document, "fetched_at", "string"), _field(document, "status", "string")
    warnings = _field(document, "warnings", "array<string>")
    images, blocks = _field(document, "image_count", "bigint"), _field(document, "block_count", "bigint")
    web = (common & (kind == "web") & normalize_url(url).isNotNull() & (tx.strip(title) != "")
           & fetched.rlike(ISO_WITH_ZONE) & F.try_to_timestamp(F.regexp_replace(fetched, " ", "T")).isNotNull()
           & status.isin("partial", "text_extracted") & warnings.isNotNull() & (images >= 0) & (blocks >= 0))
    encoding, newline = _field(document, "encoding", "string"), _field(document, "newline", "string")
    lines = _field(document, "line_count", "bigint")
    log = (common & (kind == "log") & encoding.isin(*LOG_ENCODINGS) & newline.isin(*LOG_NEWLINES)
           & (lines > 0) & (lines <= MAX_SAFE_INTEGER))
    valid = F.coalesce(web, F.lit(False)) | F.coalesce(log, F.lit(False))
    return F.when(valid, F.struct(
        kind.alias("kind"), sha.alias("sha256"), url.alias("url"), title.alias("title"), fetched.alias("fetched_at"),
        status.alias("status"), warnings.alias("warnings"), images.alias("image_count"), blocks.alias("block_count"),
        encoding.alias("encoding"), newline.alias("newline"), lines.alias("line_count")))


@F.pandas_udf(T.StringType())
def _public_host(hosts: pd.Series) -> pd.Series:
    """ASCII host name of a public address, NULL for local, private or malformed hosts."""
    def check(host):
        if not host:
            return None
        try:
            name = host.rstrip(".").encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None
        if name == "localhost" or name.endswith((".localhost", ".local")) or "%" in name:
            return None
        try:
            address = ipaddress.ip_address(name)
        except ValueError:
            labels = name.split(".")
            good = len(labels) > 1 and all(
                0 < len(label) <= 63 and not label.startswith("-") and not label.endswith("-")
                and label.replace("-", "a").isalnum() for label in labels)
            return name if good else None
        if not address.is_global or address.is_multicast:
            return None
        return f"[{name}]" if address.version == 6 else name

    return hosts.map(check)


def _quote(value: Column, safe: str) -> Column:
    """Percent-encode the characters outside the safe set, keeping existing escapes."""
    encoded = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(
        c.rlike(f"^[{safe}]$"), c).otherwise(F.url_encode(c))), "")
    return F.when(value.rlike(f"^[{safe}]*$"), value).otherwise(encoded)


def normalize_url(value) -> Column:
    """Public http(s) URL with a lower-case ASCII host and no fragment, else NULL."""
    url = tx.as_column(value)
    pattern = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    authority = F.regexp_extract(url, pattern, 2)
    host_pattern = r"^(\[[^\]]*\]|[^:\[\]@]*)(?::(\d*))?$"
    host = F.regexp_replace(F.regexp_extract(authority, host_pattern, 1), r"[\[\]]", "")
    port = F.regexp_extract(authority, host_pattern, 2)
    path = F.regexp_extract(url, pattern, 3)
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, pattern, 4), F.lit("")), r"^\?", "")
    shaped = ((F.length(url) <= 2048) & ~url.rlike(r"[\x00-\x20\\]") & (scheme != "")
              & authority.rlike(host_pattern)
              & ((port == "") | (port == F.when(scheme == "http", "80").otherwise("443"))))
    checked = _public_host(F.when(shaped, F.lower(host)))
    safe = r"A-Za-z0-9/%:@!$&'()*+,;=._~\-"
    result = F.concat(scheme, F.lit("://"), checked, F.when(path == "", "/").otherwise(_quote(path, safe)),
                      F.when(query == "", "").otherwise(F.concat(F.lit("?"), _quote(query, safe + "?"))))
    return F.when(shaped, result)
