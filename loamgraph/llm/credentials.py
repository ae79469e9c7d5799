"""Credentials embedded in source code: found through a trigram index, masked in place.

1. `index`: the inverted trigram index over the pieces of all files, in segments, written once to the shared folder. It holds postings, not texts.
2. `candidates`: each detection rule is a regular expression; the trigrams that it requires are derived from it (`trigrams`), their postings
   intersected; what is left are keys of files and the rules that can match them.
3. `verified`: the candidates' texts, and no others, are searched with the rules that can match. What a rule matches is then
   judged: placeholders, references to other places, hashes, ids, paths, public keys and embedded data are no credentials.
Masking replaces every character of the credential by X, so that quotes, lines, lengths and therefore syntax stay.

Defined results: null and empty texts hold nothing; repeated rows are searched each; lines are counted from 1 and
split at line feeds only; a credential split over lines is reported where it begins; several on one line count once in
`found`; whole texts are searched, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import trigrams
from loamgraph.session import cut

# Forms of credentials that are publicly documented or plainly marked, and words of names and placeholders.
VENDOR = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}|xox[abeoprs]-[\w-]{20,}|[a-z]{2,6}_(?:live|prod)_[A-Za-z0-9]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|ya29\.[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9])"
ISSUED = r"(?<![A-Za-z0-9-])[a-z]{2,5}-[0-9a-f]{8}-[A-Za-z0-9]{24,}(?![A-Za-z0-9-])"  # an issuer, the number of the key, the key
PEM = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
URL = r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@\"'`<>]*+:([^\s/@\"'`<>]{3,}+)@(?=[\w\[])"
HEADER = r"(?i)(?<![a-z])(?:basic|bearer|token|apikey)[ \t]+([A-Za-z0-9+/._~\-]{16,}={0,2})"
NAME_WORDS = r"(?:passw|passphrase|pass|pwd|[._-]pw|pw[._-]|secret|token|key|credential|auth)"
KEYED = r"(?i)(?<![\w.$-])[\"']?([\w.$-]{0,60}" + NAME_WORDS + r"[\w.$-]{0,60})[\"']?[ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]| ]{0,40}?)?[ \t]*(?:=>|:=|=|:)[ \t]*(?=([^\s=>]))"
CONNECTION = r"(?i)(?<=[;\"'?&`])[ \t]*(?:password|pwd|passwd|secret|sharedaccesskey|accountkey|access_token|api_?key|token)=([^;\"'`\s&<>]{6,}+)"
SPOKEN = r"(?i)(?<![\w-])(?:pw|pwd|pass|passwd|password|passphrase|passcode|secret|token|api[ -]?key)[ \t]+(?:is|was|=|:|->)[ \t]+[\"'`]?([^\s\"'`,;]{6,}+)|(?<![\w-])(?:pw|pwd|pass|passwd|password|passphrase):[ \t]*([^\s\"'`,;]{6,}+)"
LOGIN = r"(?i)(?:login|log in|credentials?|creds|account|sign in)\b[^\n]{0,60}?[: \t][ \t]*[\w.@-]{2,40}[ \t]*(?:/|:|\|)[ \t]*([^\s\"'`/]{6,}+)"
CURL = r"(?i)(?:-u|--user)[ =][\"']?[\w.@-]{1,60}:([^\s\"'`]{6,}+)"
RULES = {"vendor": VENDOR, "issued": ISSUED, "pem": PEM, "url": URL, "header": HEADER, "keyed": KEYED, "connection": CONNECTION, "spoken": SPOKEN, "login": LOGIN, "curl": CURL}
COMPILED = {k: re.compile(v) for k, v in RULES.items()}

PASSWORD_PARTS = frozenset("password passwd passphrase pass pwd pw passcode pswd".split())
SECRET_PARTS = frozenset("secret secrets token apikey credential credentials authtoken accesstoken secretkey privatekey accesskey".split())
KEY_BEFORE = frozenset("api access secret signing private auth encryption master service account app client deploy session webhook shared ssh license hmac jwt aes crypt cookie".split())
NOT_SECRET = frozenset(
    "file path name names label labels length len min max count limit url uri id ids hash hashes digest checksum sha1 sha256 sha512 md5 fingerprint type field fields prefix suffix ttl expiry expires expiration policy hint prompt placeholder env var variable ref "
    "version size age arn store manager provider factory class regex pattern rule rules title message error text help description required enabled confirm reset public pub column table index parser revision commit template format example dir directory header_name".split()
)
PLACEHOLDERS = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it|this)\d*|replace[-_ ]?(?:me|this|with.*)?|(?:your|my|the|some|insert|enter|put|add|fill|set|use)[-_ ].*|todo.*|fixme|tbd|none|null|nil|true|false|undefined|empty|default|secret|password|passwd|pass|token|dummy.*|sample.*|example.*|fake.*|test|testing|placeholder.*|redacted.*|masked|hidden|removed|xxx+.*|\*{3,}.*|\.{3,}|#{3,}|-+|_+|x+|0+|1234.*|abc123.*|foo.*|bar|baz|n/?a|admin|root|user|guest|qwerty.*|letmein|hunter2)$"
)
PLACEHOLDER_IN = re.compile(r"(?i)\$\{|\{\{|\$\(|%\(|<[^>]*>|\{[a-z_.]*\}|^\$[A-Za-z_]|^%[A-Za-z_]+%$|(?:^|[^a-z])(?:example|placeholder|changeme|your[-_]|fill-in|redacted)|EXAMPLE|xxxxx|XXXXX|\*\*\*\*|os\.environ|getenv|process\.env|import\.meta|vault:|secret://|arn:|env:|ssm:|kv/|^ENC\[|^!vault")
HASHES = re.compile(r"(?i)^(?:sha\d*[:-]|md5[:-]|\$2[aby]?\$|\$[156]\$|\$argon2|\{s?sha|pbkdf2|bcrypt|scrypt)")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
PATHLIKE = re.compile(r"^(?:[A-Za-z]:)?(?:\.{0,2}|~)[/\\][\w.\-/\\ ]*$")
IDENT = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$")
PIECES = re.compile(r"(?:\(\s*+)?(?:[rRuUbB]{0,2})(\"[^\"\n]*\"|'[^'\n]*'|`[^`\n$]*`)(?:[ \t]*+(?:[+\\][ \t]*+)?(?:#[^\n]*+|//[^\n]*+)?\r?\n?[ \t]*+(?:\+[ \t]*+)?[rRuUbB]{0,2}(?:\"[^\"\n]*\"|'[^'\n]*'))*")
STRING = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# what a key block without END goes on with: armour headers, lines of key characters, and what stands around them in code
KEY_LINES = re.compile(r"(?:\\[nr]|[\s\"'`,()#*;>|\\]|[A-Za-z-]++:[ ][^\n\\]*+|[A-Za-z0-9+/]{20,}+=*+|=[A-Za-z0-9+/]{4}(?![A-Za-z0-9])|\+(?=\s)|(?=[A-Za-z0-9]*[0-9+/=])[A-Za-z0-9+/]{2,}+=*+(?=[\"'`\\]|\s*$))*+", re.M)
CONFIG = (".env", ".ini", ".yaml", ".yml", ".toml", ".cfg", ".conf", ".properties")
CODE_JS = (".js", ".jsx", ".ts", ".tsx")


@dataclass(frozen=True)
class Hit:
    rule: str
    start: int
    spans: tuple[tuple[int, int], ...]


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def name_kind(name: str) -> str | None:
    """password, secret or None, from the words of a name."""
    parts = [p.lower() for p in PART.findall(name)]
    parts = [p for p in parts if not p.isdigit() and len(p) > 1]
    if not parts or parts[-1] in NOT_SECRET or (len(parts) > 2 and parts[0] in ("max", "min", "num")) or parts[0] in ("pub", "public"):
        return None
    if parts[-1] == "tokens" or ("public" in parts and "key" in parts):
        return None
    if any(p in PASSWORD_PARTS for p in parts):
        return "password"
    if any(p in SECRET_PARTS for p in parts) or "".join(parts[-2:]) in SECRET_PARTS:
        return "secret"
    if parts[-1] in ("key", "keys") and len(parts) > 1 and any(p in KEY_BEFORE for p in parts[:-1]):
        return "secret"
    if parts[-1] in ("auth", "authorization"):
        return "secret"
    return None


def usable(value: str, kind: str) -> bool:
    """Whether a value looks like one that opens something."""
    v = value.strip()
    if len(v) < 6 or PLACEHOLDERS.match(v) or PLACEHOLDER_IN.search(v) or HASHES.match(v) or PATHLIKE.match(v) or UUID.match(v):
        return False
    if re.search(r"\s", v) or v.startswith(("http://", "https://", "data:", "ssh-", "-----")):
        return False
    letters, digits, signs = any(c.isalpha() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)
    if kind == "password":
        mixed = len(v) >= 12 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}", v)) >= 3
        return letters and (digits or signs or mixed) and len(v) >= 6 and entropy(v) > 2 and not re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*", v)
    return letters and digits and len(v) >= 16 and entropy(v) > 3


def vendor_usable(v: str) -> bool:
    return not re.search(r"(?i)example|xxxxx|\*\*\*|0{8}|1234567890|abcdefgh", v) and entropy(v) > 2.5


def issued_usable(v: str) -> bool:
    key = v.rpartition("-")[2]
    return vendor_usable(v) and all(any(test(c) for c in key) for test in (str.isdigit, str.islower, str.isupper)) and entropy(key) > 3.5


def _basic(v: str) -> bool:
    """A basic authorization decodes to user:password."""
    try:
        user, _, word = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except ValueError:
        return False
    return bool(user) and usable(word, "password")


def find(text: str, ext: str, mask: int = -1) -> list[Hit]:
    """All credentials of a text; bit i of `mask` says whether rule i can match."""
    on = {k: bool(mask >> i & 1) for i, k in enumerate(RULES)}
    hits: list[Hit] = []
    add = lambda rule, a, b: hits.append(Hit(rule, a, ((a, b),)))
    if on["vendor"]:
        for m in COMPILED["vendor"].finditer(text):
            if vendor_usable(m[0]) and not text[: m.start()].endswith("base64,"):
                add("vendor", *m.span())
    if on["issued"]:
        for m in COMPILED["issued"].finditer(text):
            if issued_usable(m[0]):
                add("issued", *m.span())
    if on["pem"]:
        for m in COMPILED["pem"].finditer(text):
            end = text.find("-----END", m.end())
            following = text.find("-----BEGIN", m.end())
            if end < 0 or 0 <= following < end:  # no END of its own: to the last line that looks like one of a key
                end = KEY_LINES.match(text, m.end(), following if following >= 0 else len(text)).end()
            body = (m.end(), end)
            flat = re.sub(r"\\[nr]|[\s\"'+,\\]", "", text[body[0] : body[1]])
            key = re.match(r"(?:[A-Za-z-]+:[^A-Za-z0-9]*[\w, -]*)?[A-Za-z0-9+/=]*", flat)[0]
            if len(key) >= 40 and entropy(key) > 3.5:
                spans = [(body[0] + x.start(), body[0] + x.end()) for x in re.finditer(r"(?<!\\)[A-Za-z0-9+/=]{2,}", text[body[0] : body[1]])]
                spans = [(a + (1 if text[a - 1] == "\\" else 0), b) for a, b in spans]
                hits.append(Hit("pem", m.start(), tuple(spans)))
    if on["url"]:
        for m in COMPILED["url"].finditer(text):
            if usable(m[1], "password"):
                hits.append(Hit("url", m.start(), (m.span(1),)))
    if on["header"]:
        for m in COMPILED["header"].finditer(text):
            v = m[1]
            if (_basic(v) if m[0][:5].lower() == "basic" else usable(v, "secret")):
                hits.append(Hit("header", m.start(1), (m.span(1),)))
    if on["connection"]:
        for m in COMPILED["connection"].finditer(text):
            if usable(m[1], "password"):
                add("connection", *m.span(1))
    for rule in ("spoken", "login", "curl"):
        if on[rule]:
            for m in COMPILED[rule].finditer(text):
                g = 1 if m[1] is not None else 2
                v = m[g].rstrip(".,;)")
                plain = rule == "spoken" and IDENT.match(v) and not re.search(r"[A-Z]", v)
                if usable(v, "password") and any(c.isdigit() for c in v) and not plain and "(" not in v:
                    add(rule, m.start(g), m.start(g) + len(v))
    if on["keyed"]:
        config = ext in CONFIG
        for m in COMPILED["keyed"].finditer(text):
            kind = name_kind(m[1])
            if not kind:
                continue
            at = m.end()
            p = PIECES.match(text, at)
            if p:
                spans = [x.span(x.lastindex) for x in STRING.finditer(text, p.start(), p.end())]
                value = "".join(text[a:b] for a, b in spans)
                # text that goes on after the string (a call, a format) makes it something else
                rest = text[p.end() : p.end() + 3].lstrip(" \t")
                if rest[:1] in (".", "%", "[") and not config:
                    continue
                if usable(value, kind):
                    hits.append(Hit("keyed", spans[0][0], tuple(s for s in spans if s[1] > s[0])))
            elif config or text[m.start() - 1 : m.start()] in ("#", "/") or re.search(r"(?:#|//|\*|--)[^\n]*$", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
                x = re.compile(r"[^\s#;,]+(?:[#;,](?=[^\s])[^\s#;,]*)*").match(text, at)
                if x and usable(x[0], kind) and (config or any(c.isdigit() for c in x[0])):
                    add("keyed", *x.span())
    if on["vendor"] or on["issued"]:  # a token split over lines under any name
        for p in PIECES.finditer(text):
            if "\n" in p[0]:
                spans = [x.span(x.lastindex) for x in STRING.finditer(text, p.start(), p.end())]
                value = "".join(text[a:b] for a, b in spans)
                if COMPILED["vendor"].fullmatch(value) and vendor_usable(value):
                    hits.append(Hit("vendor", spans[0][0], tuple(spans)))
                elif COMPILED["issued"].fullmatch(value) and issued_usable(value):
                    hits.append(Hit("issued", spans[0][0], tuple(spans)))
    hits.sort(key=lambda h: (h.start, h.rule))
    return hits


def masked(text: str, hits: list[Hit]) -> str:
    """The text with every credential's characters replaced by X; line breaks stay."""
    spans = sorted({s for h in hits for s in h.spans})
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], re.sub(r"[^\n\r]", "X", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


INDEX = trigrams.Index([trigrams.required(p) for p in RULES.values()])


KEY = ["k1", "k2"]


def _texts(files: DataFrame) -> DataFrame:
    """The files that have a text, under a 128-bit key of what they are and hold; rows that agree in all share it."""
    ext = F.lower(F.coalesce("ext", F.regexp_extract("file_path", r"(\.[^./]+)$", 1)))
    return files.where("text is not null").select("file_id", "file_path", ext.alias("ext"), "text", F.xxhash64("file_id", "file_path", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "file_path", "file_id").alias("k2"))


def index(files: DataFrame) -> DataFrame:
    """(k1, k2, pieces, trigrams, postings), arrays: a row per segment, which is a batch of files: their keys and numbers of pieces,
    the trigrams that occur among those some rule needs, and the bitmap of pieces of each."""

    def run(batches):
        for b in batches:
            pieces, bits = INDEX.segment(b.column("text"))
            there = np.flatnonzero(bits.any(0))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [one(b.column("k1").to_numpy(), pa.int64()), one(b.column("k2").to_numpy(), pa.int64()), one(pieces.astype(np.int32), pa.int32()), one([INDEX.needed[i] for i in there], pa.string()), one([np.packbits(bits[:, i]).tobytes() for i in there], pa.binary())],
                ["k1", "k2", "pieces", "trigrams", "postings"],
            )

    return _texts(files).select(*KEY, "text").mapInArrow(run, "k1 array<bigint>, k2 array<bigint>, pieces array<int>, trigrams array<string>, postings array<binary>")


def candidates(postings: DataFrame) -> DataFrame:
    """(k1, k2, mask, pieces): the files that some rule can match, from the index alone; bit i of the mask is rule i."""

    def run(batches):
        for b in batches:
            for k1, k2, pieces, trigrams_, bitmaps in zip(*(b.column(c) for c in ("k1", "k2", "pieces", "trigrams", "postings"))):
                pieces = np.asarray(pieces.values)
                n = int(pieces.sum())
                lists = {t: np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for t, x in zip(trigrams_.as_py(), bitmaps.as_py())}
                masks = INDEX.masks(pieces, lists)
                some = np.flatnonzero(masks)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(k1.values)[some]), pa.array(np.asarray(k2.values)[some]), pa.array(masks[some].astype(np.int32)), pa.array(pieces[some].astype(np.int32))], [*KEY, "mask", "pieces"])

    return postings.mapInArrow(run, "k1 bigint, k2 bigint, mask int, pieces int")


def verified(files: DataFrame, found: DataFrame, rows_of, schema: str) -> DataFrame:  # noqa: ANN001
    """`rows_of(file_id, file_path, text, hits)` for each candidate file with hits."""
    masks = found.groupBy(*KEY).agg(F.bit_or("mask").alias("mask"))  # equal files in several segments
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = []
            for i, path, ext, text, mask in zip(*(b.column(c).to_pylist() for c in ("file_id", "file_path", "ext", "text", "mask"))):
                hits = find(text, ext or "", mask)
                if hits:
                    rows += rows_of(i, path, text, hits)
            cols = list(zip(*rows)) or [[] for _ in names]
            kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.strip().split(" ")[1]]) for c, x in zip(cols, schema.split(","))], names)

    return _texts(files).join(masks, KEY).select("file_id", "file_path", "ext", "text", "mask").mapInArrow(run, schema)


def _places(i, path, text, hits):  # noqa: ANN001
    lines = sorted({(h.start, h.rule) for h in hits})
    return sorted({(i, path, text.count("\n", 0, at) + 1, rule) for at, rule in lines})


def credentials(files: DataFrame) -> DataFrame:
    """(file_id, file_path, line_no, rule): each place once per rule."""
    postings, _ = cut(index(files), "trigrams")
    return verified(files, candidates(postings), _places, "file_id bigint, file_path string, line_no int, rule string")


def redacted(files: DataFrame) -> DataFrame:
    """(file_id, file_path, found, text): the files with credentials, masked."""
    postings, _ = cut(index(files), "trigrams")
    return verified(files, candidates(postings), lambda i, path, text, hits: [(i, path, len({h.start for h in hits}), masked(text, hits))], "file_id bigint, file_path string, found int, text string")


def index_report(files: DataFrame) -> DataFrame:
    """(rule, files, pieces, verified_files, verified_pieces): how much of all is verified for each rule, and for any."""
    postings, _ = cut(index(files), "trigrams")
    total = postings.agg(F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("files"), F.coalesce(F.sum(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("pieces")).first()
    each = F.array(*[F.struct(F.lit(k).alias("rule"), (F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1).alias("can")) for i, k in enumerate(RULES)], F.struct(F.lit("any").alias("rule"), F.lit(True).alias("can")))
    by = candidates(postings).select("pieces", F.explode(each).alias("x")).where("x.can").groupBy("x.rule").agg(F.count("*").alias("verified_files"), F.sum("pieces").alias("verified_pieces"))
    return by.select("rule", F.lit(total["files"]).alias("files"), F.lit(total["pieces"]).alias("pieces"), "verified_files", "verified_pieces")
