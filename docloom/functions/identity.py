"""Keys, scopes, expiry and validation of accounts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import casefold

SCOPES = ("api", "mcp", "admin")


def hash_key(key: Column) -> Column:
    return F.sha2(key, 256)


def display_prefix(key: Column, chars: int = 12) -> Column:
    return F.substring(key, 1, chars)


def parse_scopes(text: Column) -> Column:
    """Known scopes of a comma list in canonical order; unknown ones go."""
    return F.array_intersect(F.array(*[F.lit(s) for s in SCOPES]), F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)))


def write_scopes(scopes: Column) -> Column:
    return F.array_join(F.array_intersect(F.array(*[F.lit(s) for s in SCOPES]), scopes), ",")


def is_expired(expires_at: Column, now: Column) -> Column:
    """No date never expires; a date that can't be read is expired."""
    return expires_at.isNotNull() & F.coalesce(F.try_to_timestamp(expires_at) <= now, F.lit(True))


def should_touch(last_used: Column, now: Column, seconds: int = 60) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(last_used)) >= seconds, F.lit(True))


def attempt_key(client_ip: Column, username: Column) -> Column:
    """struct(client_ip, username) that login attempts are counted by: no address is empty, and case doesn't matter."""
    return F.struct(F.coalesce(client_ip, F.lit("")).alias("client_ip"), casefold(username).alias("username"))


def valid_username(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9._-]{3,64}$"), F.lit(False))


def valid_password(word: Column, least: int = 12) -> Column:
    return F.coalesce(F.length(word) >= least, F.lit(False))


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin("admin", "member", "readonly"), F.lit(False))


def valid_email(email: Column) -> Column:
    """No address is fine."""
    return email.isNull() | email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def valid_display_name(name: Column, most: int = 120) -> Column:
    return name.isNull() | (F.length(name) <= most)


def asker_name(name: Column, most: int = 80) -> Column:
    """One line without fence marks, cut to length; null if nothing is left."""
    line = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", " "), "<<<|>>>", ""))
    return F.nullif(F.trim(F.substring(line, 1, most)), F.lit(""))


def document_url(base: str, document_id: Column) -> Column:
    return F.concat(F.lit(base), F.lit("/documents/"), document_id.cast("string"), F.lit("/"))
