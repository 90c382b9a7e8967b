"""Encrypted scripts, packed files, and the two kinds of settings tables: bytes to rows and back."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict

from .bytes import (
    HEADERLESS_KEY, SCRIPT_KEYS, SETTINGS_KEY, FormatError, float_bits, float_text, from_1252, script_stream, settings_stream, to_1252, xor,
)

SCRIPT_MAGIC = b"SCR\x01"
_PRINTABLE = re.compile(rb"[\x20-\x7e\t\r\n]*")
_KEY = re.compile(r"\A// ?KEY:0x([0-9a-f]+)[^\S\r\n]*(?:\r\n|\r|\n)?", re.IGNORECASE)
LINE = "\r\n"

# scripts


def script_key(data: bytes) -> int | None:
    """The first known key under which the tail of a script is printable. The cipher runs from the end."""
    body = data[len(SCRIPT_MAGIC) :]
    if len(body) < 2:
        return None
    tail = body[: -min(32, len(body) - 1) - 1 : -1]
    return next((k for k in SCRIPT_KEYS if _PRINTABLE.fullmatch(xor(tail, script_stream(k, len(tail))))), None)


def script_text(data: bytes, key: int | None = None) -> str:
    """The text of a script below a comment that names its key. Without the mark it is the headerless kind."""
    if key is None:
        key = script_key(data) if data.startswith(SCRIPT_MAGIC) else HEADERLESS_KEY if data[:1] != b"S" and data[1:2] != b"C" and data[2:3] != b"R" else None
    if key is None:
        raise FormatError("no known key opens the script")
    body = data[0 if key == HEADERLESS_KEY else len(SCRIPT_MAGIC) :][::-1]
    plain = from_1252(xor(body, script_stream(key, len(body))))
    return f"// KEY:0x{key:08X}{LINE}" + _KEY.sub("", plain)


def script_bytes(text: str, key: int | None = None) -> bytes:
    """A script from text; the key is given or named in a leading comment."""
    named = _KEY.match(text)
    if key is None and not named:
        raise FormatError("no key given or named")
    key = int(named[1], 16) if key is None else key
    body = to_1252(_KEY.sub("", text))
    return (b"" if key == HEADERLESS_KEY else SCRIPT_MAGIC) + xor(body, script_stream(key, len(body)))[::-1]


# packed files


def unpack_bfc(data: bytes) -> bytes:
    """The content of a packed file; its size field is a hint and not relied on."""
    if data[:4] != b"BFC1" or len(data) < 10:
        raise FormatError("not a packed file")
    try:
        return zlib.decompress(data[8:])
    except zlib.error as e:
        raise FormatError(str(e)) from e


def pack_bfc(content: bytes) -> bytes:
    return b"BFC1" + struct.pack("<i", len(content)) + zlib.compress(content, 9)


# settings with typed values

Row = tuple[int, str, int, str, int, int, str]  # group, section, key number, key, value number, type, value
INT, FLOAT, STRING = 1, 2, 4


def _strings(data: bytes) -> list[str]:
    return [from_1252(x) for x in data.split(b"\0")[:-1]] if data else []


def cbin_rows(data: bytes) -> tuple[int, list[dict]]:
    """(key, groups): groups of section and entries, entries of key and (type, value) pairs."""
    if data[:4] != b"CBIN" or len(data) < 24:
        raise FormatError("not a settings file")
    at, size, count, key = struct.unpack_from("<IIII", data, 4)
    if not at or not size or not count or not key or at + size > len(data):
        raise FormatError("the string table is not in the file")
    plain = data[:20] + xor(data[20:], settings_stream(key, len(data) - 20))
    names = [""] + _strings(plain[at : at + size])

    def name(i: int) -> str:
        return names[i] if 0 < i < len(names) else ""

    (n,) = struct.unpack_from("<I", plain, 20)
    heads = [struct.unpack_from("<II", plain, 24 + 8 * i) for i in range(n)]
    pos, groups = 24 + 8 * n, []
    for section, entries in heads:
        keys = [struct.unpack_from("<II", plain, pos + 8 * i) for i in range(entries)]
        pos += 8 * entries + (8 if entries else 0)
        groups.append({"section": name(section), "entries": [{"key": name(k), "values": [None] * c} for k, c in keys]})
    for g in groups:
        for e in g["entries"]:
            for i in range(len(e["values"])):
                raw, kind = struct.unpack_from("<Ii", plain, pos)
                pos += 8
                text = {INT: lambda r: str(r - (r >> 31 << 32)), FLOAT: float_text, STRING: name}.get(kind, str)(raw)
                e["values"][i] = (kind, text)
    return key, groups


def cbin_bytes(groups: list[dict], key: int = SETTINGS_KEY) -> bytes:
    """The inverse: strings are interned in the order sections, keys, values, ids from 1."""
    ids: dict[str, int] = defaultdict(lambda: len(ids) + 1)
    for g in groups:
        ids[g["section"]]
    for g in groups:
        for e in g["entries"]:
            ids[e["key"]]
    values = [v for g in groups for e in g["entries"] for v in e["values"]]
    for kind, text in values:
        if kind == STRING:
            ids[text]
    # a bytearray: bytes would be copied whole for each value
    out = bytearray(struct.pack("<I", len(groups)) + b"".join(struct.pack("<II", ids[g["section"]], len(g["entries"])) for g in groups))
    for g in groups:
        if g["entries"]:
            out += b"".join(struct.pack("<II", ids[e["key"]], len(e["values"])) for e in g["entries"]) + b"\0" * 8
    for kind, text in values:
        if kind == STRING:
            raw = ids[text]
        elif kind == FLOAT:
            raw = float_bits(text) or 0
        else:
            raw = int(text) & 0xFFFFFFFF if re.fullmatch(r"[+-]?[0-9]+", text) else 0
        out += struct.pack("<Ii", raw, kind)
    table = b"".join(to_1252(s) + b"\0" for s in ids)
    head = b"CBIN" + struct.pack("<IIII", 20 + len(out), len(table), len(ids), key)
    return head + xor(out + table, settings_stream(key, len(out) + len(table)))


def cbin_text(key: int, groups: list[dict]) -> str:
    """Settings as text: [section] lines and key = values."""
    lines = [f"// KEY:0x{key:08X}"]
    for g in groups:
        lines += ["", f"[{g['section']}]"]
        for e in g["entries"]:
            shown = [v if kind != STRING or v == "//" else '"' + v.replace('"', '\\"') + '"' for kind, v in e["values"]]
            lines.append(f"{e['key']} = {','.join(shown).replace(',//,', '\t//')}" if shown else f"{e['key']} =")
    return LINE.join(lines) + LINE


_VALUE = re.compile(r'\s*("(?:\\.|[^"\\])*"|[^,]+)')


def cbin_parse(text: str) -> tuple[int, list[dict]]:
    """The inverse of cbin_text. Two slashes inside a value become a value of their own, even between quotes."""
    named = _KEY.match(text)
    key = int(named[1], 16) if named else SETTINGS_KEY
    groups: list[dict] = []
    for line in re.split(r"\r\n|\r|\n", _KEY.sub("", text.replace("\0", ""))):
        line = line.strip()
        if not line:
            continue
        if line.startswith("["):
            groups.append({"section": re.sub(r"[^a-z0-9_]", "", line.strip("[]"), flags=re.IGNORECASE), "entries": []})
            continue
        if not groups or "=" not in line:
            raise FormatError(f"not a section or a key: {line}")
        name, _, rest = line.partition("=")
        values = []
        for token in _VALUE.findall(re.sub(r"\s*//\s*", ",//,", rest)):
            token = token.strip()
            if not token:
                continue
            if token.startswith('"') and token.endswith('"') and len(token) > 1:
                values.append((STRING, token[1:-1].replace('\\"', '"')))
            elif token == "//":
                values.append((STRING, token))
            elif float_bits(token) is not None:
                values.append((FLOAT, float_text(float_bits(token))))
            elif re.fullmatch(r"[+-]?[0-9]+", token):
                values.append((INT, str(int(token))))
            elif "//" in [v for _, v in values]:  # what follows a comment mark is the comment
                values.append((STRING, token))
            else:
                raise FormatError(f"not a value: {token}")
        groups[-1]["entries"].append({"key": re.sub(r"[^a-z0-9/_: ]", "", name.strip(), flags=re.IGNORECASE), "values": values})
    return key, groups


def cbin_json(key: int, groups: list[dict]) -> str:
    return json.dumps({"EncryptionKey": key, "Groups": [
        {"Section": g["section"], "Entries": [{"Key": e["key"], "Values": [{"Type": t, "Value": v} for t, v in e["values"]]} for e in g["entries"]]} for g in groups]})


def cbin_from_json(text: str) -> tuple[int, list[dict]]:
    doc = json.loads(text)
    return doc["EncryptionKey"], [
        {"section": g["Section"], "entries": [{"key": e["Key"], "values": [(v["Type"], v["Value"]) for v in e["Values"]]} for e in g["Entries"]]} for g in doc["Groups"]]


# texts with positions


def rtxt_rows(data: bytes, strict: bool = False) -> list[dict]:
    """Groups of section (None for values alone) and entries (key or None, value, x, y).

    Keys and sections are ASCII, values of the code page. A value ends where the next begins. strict refuses non-ASCII keys.
    """
    if data[:4] != b"RTXT" or len(data) < 20:
        raise FormatError("not a text table")
    table, _, count = struct.unpack_from("<iii", data, 4)
    base = 16 + 16 * count
    if table < base or count < 0 or table + 4 > len(data):
        raise FormatError("the tables are not in the file")
    (n,) = struct.unpack_from("<i", data, table)

    def ascii_strings(at: int, k: int) -> list[str]:
        out = []
        for _ in range(k):
            end = data.index(b"\0", at)
            out.append(data[at:end].decode("ascii", "strict" if strict else "replace").replace("\ufffd", "?"))
            at = end + 1
        return out

    start = table + 4
    heads = [struct.unpack_from("<ii", data, start + 8 * i) for i in range(n)]
    sections = ascii_strings(start + 8 * n, n)
    groups = []
    for i, (at, entries) in enumerate(heads):
        if i == 0 and at < 8 * n:  # some files point the first group into the heads
            at = 8 * n + sum(len(s) + 1 for s in sections)
        groups.append({"section": sections[i] or None, "keys": [k or None for k in ascii_strings(start + at, entries)], "entries": []})
    if not groups:
        groups.append({"section": None, "keys": [None] * count, "entries": []})
    refs = [struct.unpack_from("<ihhh", data, 16 + 16 * i) for i in range(count)]
    for i, (at, x, y, group) in enumerate(refs):
        end = base + refs[i + 1][0] if i + 1 < count else table
        value = from_1252(data[base + at : max(base + at, end - 1)])
        own = groups[group if group >= 0 else 0]
        key = own["keys"][len(own["entries"])] if len(own["entries"]) < len(own["keys"]) else None
        own["entries"].append({"key": key, "value": value, "x": x, "y": y})
    for g in groups:  # keys without a value keep an empty place
        g["entries"] += [{"key": k, "value": None, "x": 0, "y": 0} for k in g.pop("keys")[len(g["entries"]) :]]
    return groups


def rtxt_bytes(groups: list[dict]) -> bytes:
    """The inverse of rtxt_rows."""
    alone = len(groups) == 1 and not groups[0]["section"]
    refs, values = b"", b""
    for i, g in enumerate(groups):
        for e in g["entries"]:
            refs += struct.pack("<ihhh", len(values), e["x"], e["y"], -1 if alone else i) + b"\0" * 6
            values += to_1252(e["value"] or "") + b"\0"
    heads, names, keys = b"", b"", b""
    if not alone:
        names = b"".join((g["section"] or "").encode("ascii", "replace") + b"\0" for g in groups)
        for g in groups:
            heads += struct.pack("<ii", 8 * len(groups) + len(names) + len(keys), len(g["entries"]))
            keys += b"".join((e["key"] or "").encode("ascii", "replace") + b"\0" for e in g["entries"])
    rest = heads + names + keys
    head = b"RTXT" + struct.pack("<iii", 16 + len(refs) + len(values), len(rest), len(refs) // 16)
    return head + refs + values + struct.pack("<i", 0 if alone else len(groups)) + rest


def rtxt_text(groups: list[dict]) -> str:
    """Text tables as text: [section] lines, key = "value" with its position before it where it has one."""
    lines = []
    for g in groups:
        lines += [f"[{g['section']}]"] if g["section"] else []
        for e in g["entries"]:
            place = f"[x={e['x']},y={e['y']}]" if g["section"] and (e["x"] or e["y"]) else ""
            value = place + (e["value"] or "").replace("\\", "\\\\").replace('"', '\\"').replace("\r", "\\r").replace("\n", "\\n")
            lines.append(f'{e["key"]} = "{value}"' if e["key"] is not None else f'"{value}"')
    return LINE.join(lines) + LINE


_PAIR = re.compile(r'^(?:([^"=]*?)\s*=\s*)?"((?:\\.|[^"\\])*)"$')
_PLACE = re.compile(r"^\[x=(-?\d+),y=(-?\d+)\]")
_ESCAPE = {"\\\\": "\\", '\\"': '"', "\\r": "\r", "\\n": "\n"}


def rtxt_parse(text: str) -> list[dict]:
    """The inverse of rtxt_text."""
    groups: list[dict] = []
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        line = line.strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            groups.append({"section": line[1:-1], "entries": []})
            continue
        m = _PAIR.match(line)
        if not m:
            raise FormatError(f"line {number}: {line}")
        if not groups:
            groups.append({"section": None, "entries": []})
        value, x, y = m[2], 0, 0
        if p := _PLACE.match(value):
            value, x, y = value[p.end() :], int(p[1]), int(p[2])
        value = re.sub(r"\\.", lambda e: _ESCAPE.get(e[0], e[0]), value)
        groups[-1]["entries"].append({"key": m[1], "value": value, "x": x, "y": y})
    return groups
