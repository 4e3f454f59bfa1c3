"""URL and address policy as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex import dims


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once; else each use repeats its whole expression."""
    return F.get(F.transform(F.array(value), body), 0)


_PART = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def is_ipv4(ip: Column) -> Column:
    """Four parts of 0 to 255 without leading zeros."""
    return ip.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")


def ipv4_value(ip: Column) -> Column:
    """What is_ipv4 found, as a bigint; without a lambda, as Spark compiles those not."""
    one = lambda k: F.split_part(ip, F.lit("."), F.lit(k)).cast("bigint")
    return ((one(1) * 256 + one(2)) * 256 + one(3)) * 256 + one(4)


def ipv4_number(ip: Column) -> Column:
    """The address as a bigint; null unless is_ipv4."""
    return F.when(is_ipv4(ip), ipv4_value(ip))


def _block(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    number = 0
    for p in base.split("."):
        number = number * 256 + int(p)
    return number, 1 << (32 - int(bits))


def ipv4_reason(number: Column) -> Column:
    """Why an address is blocked; null if it is allowed. The first block that holds it decides."""

    def rules(n: Column) -> Column:
        out = F.when(n.isNull(), "unparseable IPv4 address")
        for cidr, why in dims.IPV4_BLOCKS:
            base, size = _block(cidr)
            out = out.when((n >= base) & (n < base + size), f"blocked address range {cidr} ({why})")
        return out

    return let(number, rules)


def ipv6_words(ip: Column) -> Column:
    """Eight 16-bit words of an IPv6 address (zones, brackets and embedded IPv4 read); null if malformed."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(ip)), r"^\[(.*)\]$", "$1"), "%.*$", "")
    none = F.array().cast("array<string>")
    words = lambda s: F.when(s == "", none).otherwise(F.split(s, ":", -1))

    def hexed(a: Column) -> Column:
        tail = F.regexp_extract(a, r"([^:]*)$", 1)
        as_words = lambda n: F.concat(F.regexp_extract(a, r"^(.*:)[^:]*$", 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
        return F.when(tail.contains("."), let(ipv4_number(tail), as_words)).otherwise(a)

    def filled(head: Column, rest: Column) -> Column:
        fill = F.lit(8) - F.size(head) - F.size(rest)
        return F.when(fill >= 0, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), rest))

    def full(sides: Column) -> Column:
        both = let(words(F.get(sides, 0)), lambda h: let(words(F.coalesce(F.get(sides, 1), F.lit(""))), lambda r: filled(h, r)))
        return F.when(F.size(sides) == 1, words(F.get(sides, 0))).when(F.size(sides) == 2, both)

    numbers = lambda v: F.when((F.size(v) == 8) & F.forall(v, lambda w: w.rlike("^[0-9a-f]{1,4}$")), F.transform(v, lambda w: F.conv(w, 16, 10).cast("int")))
    return let(let(let(let(bare, hexed), lambda a: F.split(a, "::", -1)), full), numbers)


def embedded_ipv4(words: Column) -> Column:
    """The IPv4 number in a mapped or compatible address; null in others."""
    w = lambda i: F.get(words, i)
    zeros = F.forall(F.slice(words, 1, 5), lambda x: x == 0)
    mapped = zeros & (w(5) == 65535)
    compatible = zeros & (w(5) == 0) & ((w(6) != 0) | (w(7) > 1))
    return F.when(mapped | compatible, w(6).cast("bigint") * 65536 + w(7))


def ip_reason(ip: Column) -> Column:
    """Why an address (IPv4 or IPv6) is blocked; null if allowed.

    The ranges are those that the rules name in code: link-local is fe80 exactly, the 6to4 rule tests 0200::/7.
    """

    def rules(words: Column) -> Column:
        w = lambda i: F.get(words, i)
        inner = embedded_ipv4(words)
        return (
            F.when(words.isNull(), "unparseable IPv6 address")
            .when(F.forall(words, lambda x: x == 0), "unspecified address")
            .when(F.forall(F.slice(words, 1, 7), lambda x: x == 0) & (w(7) == 1), "loopback")
            .when(inner.isNotNull(), ipv4_reason(inner))
            .when(w(0) == 0xFE80, "link-local")
            .when(w(0).bitwiseAND(F.lit(0xFE00)) == 0xFC00, "unique local address (fc00::/7)")
            .when(w(0).bitwiseAND(F.lit(0xFF00)) == 0xFF00, "multicast")
            .when((w(0) == 0x2001) & (w(1) == 0x0DB8), "documentation range")
            .when((w(0) == 0x0100) & F.forall(F.slice(words, 2, 4), lambda x: x == 0), "discard prefix (100::/64)")
            .when((w(0) == 0x2001) & (w(1).bitwiseAND(F.lit(0xFFFD)) == 0), "Teredo tunnel address")
            .when((w(0).bitwiseAND(F.lit(0xFE00)) == 0x0200) & (w(1) == 0), "3gpp6 (2002::/16)")
        )

    return F.when(ip.contains(":"), let(ipv6_words(ip), rules)).otherwise(ipv4_reason(ipv4_number(ip)))


def is_ip_literal(host: Column) -> Column:
    """Whether a host is a bare address; false for null."""
    return F.coalesce(F.when(host.contains(":"), ipv6_words(host).isNotNull()).otherwise(ipv4_number(host).isNotNull()), F.lit(False))


def url_parts(url: Column) -> dict[str, Column]:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":\d*$", "")
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
        "credentials": F.regexp_extract(rest, "^(.*)@", 1),
        "host": F.lower(F.regexp_replace(host, r"^\[|\]$", "")),
        "port": F.regexp_extract(rest, r":(\d+)$", 1),
    }


def url_verdict(url: str, allow_http: bool = False, ports: tuple[int, ...] = (443,), hosts: tuple[str, ...] = ()) -> Column:
    """The error code of the first rule that the URL in a column breaks; null if it may be fetched."""
    return verdict(F.col(url), allow_http, ports, hosts)


def verdict(url: Column, allow_http: bool = False, ports: tuple[int, ...] = (443,), hosts: tuple[str, ...] = ()) -> Column:
    u = F.trim(url)
    p = url_parts(u)
    host, port = p["host"], p["port"]
    suspicious = F.lit(False)
    for pattern, _ in dims.SUSPICIOUS_HOSTS:
        suspicious = suspicious | host.rlike(pattern)
    number = F.when(port != "", port.cast("int")).otherwise(F.when(p["scheme"] == "http", 80).otherwise(443))
    default = ((p["scheme"] == "http") & (number == 80)) | ((p["scheme"] == "https") & (number == 443))
    out = (
        F.when(url.isNull() | (u == ""), "VALIDATION_ERROR")
        .when((F.char_length(u) > dims.MAX_URL_LENGTH) | (p["scheme"] == ""), "INVALID_URL")
        .when(~p["scheme"].isin("http", "https"), "UNSUPPORTED_SCHEME")
        .when((p["credentials"] != "") | (host == ""), "INVALID_URL")
        .when(host.rlike(r"^\d+$") | host.rlike("^0x[0-9a-f]+$") | suspicious, "BLOCKED_URL")
        .when((p["scheme"] == "http") & F.lit(not allow_http), "UNSUPPORTED_SCHEME")
        .when(~(number.isin(*ports) | default), "INVALID_URL")
    )
    if hosts:
        out = out.when(~host_listed(host, hosts), "BLOCKED_URL")
    return out


def host_listed(host: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a host is one of the list or below one."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def redacted(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#@]*@", "$1")


def addresses_reason(addresses: Column) -> Column:
    """Why a host with these addresses is refused: it has none, or the first of them that is refused; null if all may pass."""
    why = F.filter(F.transform(addresses, ip_reason), lambda r: r.isNotNull())
    return F.when(addresses.isNull() | (F.size(addresses) == 0), "no address").otherwise(F.get(why, 0))
