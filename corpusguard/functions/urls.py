"""URL references split with string expressions.

``parse_url`` rejects spaces, ``|`` and other characters that occur in real
links, so the split follows RFC 3986 delimiters directly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.functions.text import let

# Character sets a reference must keep to.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_CONTROL = r"[\x00-\x1F\x7F]"
_USERINFO = r"^[A-Za-z0-9._:~!$&'()*+,;=%@-]*\z"
_HOST_CHAR = r"""[A-Za-z0-9!$&'()*+,;=<>"\[\]._~-]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f]"""
_HOST = rf"^(?:\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%25[^\]]+)?\]|(?:{_HOST_CHAR})*)(?::[0-9]*)?\z"


def decodes(value: Column) -> Column:
    return ~F.rlike(value, F.lit(_BAD_ESCAPE))


def percent_decode(value: Column) -> Column:
    """Percent decoding that keeps ``+``; call only where ``decodes`` holds."""
    return F.when(~F.contains(value, F.lit("%")), value).otherwise(
        F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), F.lit(""))
    )


def _authority_ok(authority: Column) -> Column:
    user = F.regexp_extract(authority, r"(?s)^(.*)@", 1)
    host = F.substring_index(authority, "@", -1)
    return F.rlike(user, F.lit(_USERINFO)) & decodes(user) & F.rlike(host, F.lit(_HOST))


def hostname(authority: Column) -> Column:
    host = F.substring_index(authority, "@", -1)
    bare = F.regexp_replace(host, r":[0-9]*\z", "")
    return F.lower(F.regexp_replace(bare, r"^\[|\]\z", ""))


def split_url(raw: Column) -> Column:
    """``struct(valid, scheme, authority, path)`` with the path decoded once."""

    def with_rest(cut: Column) -> Column:
        scheme = F.lower(F.regexp_extract(cut["head"], _SCHEME, 1))
        return let(
            F.struct(
                scheme.alias("scheme"),
                F.substring_index(
                    F.when(scheme != "", F.substr(cut["head"], F.length(scheme) + 2)).otherwise(cut["head"]),
                    "?",
                    1,
                ).alias("hier"),
                cut["head"].alias("head"),
                cut["fragment"].alias("fragment"),
            ),
            with_authority,
        )

    def with_authority(p: Column) -> Column:
        no_scheme = p["scheme"] == ""
        absolute = F.startswith(p["hier"], F.lit("/"))
        present = F.startswith(p["hier"], F.lit("//")) & (
            ~no_scheme | ~F.startswith(p["hier"], F.lit("///"))
        )
        authority = F.when(present, F.regexp_extract(p["hier"], "^//([^/]*)", 1)).otherwise(F.lit(""))
        path = (
            F.when(~no_scheme & ~absolute, F.lit(""))
            .when(present, F.substr(p["hier"], F.length(authority) + 3))
            .otherwise(p["hier"])
        )
        colon_first = no_scheme & ~absolute & F.contains(F.substring_index(p["hier"], "/", 1), F.lit(":"))
        well_formed = (
            ~F.rlike(p["head"], F.lit(_CONTROL))
            & ~F.startswith(p["head"], F.lit(":"))
            & ~colon_first
            & decodes(p["fragment"])
        )
        return let(
            F.struct(
                well_formed.alias("ok"),
                p["scheme"].alias("scheme"),
                authority.alias("authority"),
                path.alias("path"),
            ),
            lambda q: F.struct(
                (q["ok"] & decodes(q["path"]) & ((q["authority"] == "") | _authority_ok(q["authority"]))).alias(
                    "valid"
                ),
                q["scheme"].alias("scheme"),
                q["authority"].alias("authority"),
                F.when(decodes(q["path"]), percent_decode(q["path"])).otherwise(F.lit("")).alias("path"),
            ),
        )

    head = F.substring_index(raw, "#", 1)
    return let(
        F.struct(head.alias("head"), F.substr(raw, F.length(head) + 2).alias("fragment")),
        with_rest,
    )
