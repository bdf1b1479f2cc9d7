"""Labelled findings for the secret scanner: documents made by rule, whose secrets are known.

Each document is a few lines of filler with one value in a setting.  Values that are secrets: provider
keys, random keys in several alphabets and lengths, made passwords.  Hard negatives look like them or
stand where they stand: digests, commit and request ids, card numbers, encoded images, placeholders,
references and calls assigned to a credential's name, addresses, paths, identifiers, plain words.
Document k is the same on every run and every partitioning.
"""

from __future__ import annotations

import random
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops

#: Documents made: a bound on what the forest learns from.
DOCUMENTS = 8_000

_HEX, _ALNUM = string.digits + "abcdef", string.ascii_letters + string.digits
_CREDENTIALS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "db_password", "SECRET_KEY", "accessToken", "private_key", "credentials")
_OTHERS = ("checksum", "sha256", "md5", "commit", "etag", "request_id", "build", "digest", "id", "uuid", "revision", "order", "hash", "name", "file", "note", "title")
_PATHS = ("", "web", "notes", "src/app.py", "config/settings.yml", "deploy/.env", "docs/readme.md", "lib/util.js", "a/b/c/data.json", "forum", "etc/service.conf", "main.tf")
_SYLLABLES = ("an", "er", "the", "ti", "re", "on", "la", "de", "és", "que", "con", "ver", "mal", "or", "ent", "st", "ing")


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 5)))


def _some(rnd: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high)))


def secret(rnd: random.Random) -> str:
    kind = rnd.randrange(8)
    if kind == 0:
        return rnd.choice(["AKIA" + _some(rnd, string.ascii_uppercase + string.digits, 16, 16), "ghp_" + _some(rnd, _ALNUM, 36, 36), "xoxb-" + _some(rnd, string.digits, 10, 12) + "-" + _some(rnd, _ALNUM, 20, 24), "sk_live_" + _some(rnd, _ALNUM, 24, 32)])
    if kind in (1, 2, 3):
        return _some(rnd, rnd.choice([_HEX, _HEX, _HEX.upper()]), *rnd.choice([(32, 32), (40, 40), (64, 64), (16, 48)]))
    if kind == 4:
        return _some(rnd, _ALNUM + "-_", 20, 64)
    if kind == 5:
        return _some(rnd, _ALNUM + "+/", 30, 86) + rnd.choice(["", "=", "=="])
    if kind == 6:
        return _some(rnd, _ALNUM, 14, 40)
    return _some(rnd, string.ascii_letters, 2, 4) + _some(rnd, _ALNUM + "!#%*", 10, 20) + _some(rnd, _ALNUM, 2, 4)


def _plain(rnd: random.Random) -> str:
    """A value that is no secret, whatever stands around it."""
    words = [_word(rnd) for _ in range(rnd.randint(2, 4))]
    kind = rnd.randrange(10)
    if kind == 0:
        return rnd.choice(["your_{}_here", "<{}-goes-here>", "${{{}_{}}}", "change_me_{}", "example-{}-{}"]).replace("{}", words[0]).replace("{{", "{").replace("}}", "}")
    if kind == 1:
        return rnd.choice(["x", "*", "0", "."]) * rnd.randint(12, 40)
    if kind == 2:
        return f"{words[0]}.{words[1]}{rnd.randrange(99)}@{_word(rnd)}.example.com"
    if kind == 3:
        return f"https://{words[0]}.example.org/{'/'.join(words)}"
    if kind == 4:
        return "/" + "/".join(words) + rnd.choice(["", ".txt", ".py"])
    if kind == 5:
        return rnd.choice(["_", "-", ""]).join([words[0], *[w.capitalize() for w in words[1:]]]) + words[0]
    if kind == 6:
        return f"get_{words[0]}_{words[1]}(request.{words[-1]})"
    if kind == 7:
        return _some(rnd, string.digits, 12, 19)
    if kind == 8:
        return f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}:{rnd.randint(10, 59)}:00Z"
    joined = "".join(words) + words[0] + words[-1]
    return joined.upper() if rnd.random() < 0.3 else joined


def _settled(rnd: random.Random, name: str, value: str) -> str:
    form = rnd.choice(['{n} = "{v}"', "{n}={v}", "{n}: {v}", "'{n}': '{v}',", '{{"{n}":"{v}","x":1}}', "export {n}={v}", '{n} := "{v}";', "http://h.example.net/p?a=1&{n}={v}"])
    return form.format(n=name, v=value)


def document(k: int, seed: int = 17) -> tuple[str, str, list[str]]:
    """(text, path, its secrets) of document k."""
    rnd = random.Random(seed * 1_000_003 + k)
    filler = lambda low, high: " ".join(_word(rnd) for _ in range(rnd.randint(low, high)))
    kind, secrets = rnd.randrange(8), []
    if kind < 3:
        value = secret(rnd)
        secrets.append(value)
        setting = f"Authorization: Bearer {value}" if rnd.random() < 0.1 else _settled(rnd, rnd.choice(_CREDENTIALS), value)
    elif kind == 3:  # looks like a secret, is none
        value = rnd.choice([str(uuid.UUID(int=rnd.getrandbits(128))), _some(rnd, _HEX, 32, 32), _some(rnd, _HEX, 40, 40), _some(rnd, _HEX, 64, 64)])
        setting = rnd.choice([f"{rnd.choice(_OTHERS)} {value}", _settled(rnd, rnd.choice(_OTHERS), value)])
    elif kind == 4:
        setting = rnd.choice([_settled(rnd, rnd.choice(_OTHERS), _plain(rnd)), f"src=data:image/png;base64,{_some(rnd, _ALNUM + '+/', 60, 300)}"])
    elif kind == 5:  # stands where a secret stands
        setting = _settled(rnd, rnd.choice(_CREDENTIALS), _plain(rnd))
    else:
        setting = _plain(rnd)
    return f"{filler(0, 12)} {setting} {filler(0, 12)}", rnd.choice(_PATHS), secrets


def documents(spark: SparkSession, n: int = DOCUMENTS, seed: int = 17) -> DataFrame:
    """Rows (doc_id, text, path, secrets)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, paths, secrets = zip(*[document(k, seed) for k in ids], strict=True) if ids else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(paths, pa.string()), pa.array(secrets, pa.list_(pa.string()))], names=["doc_id", "text", "path", "secrets"])

    return spark.range(0, n, 1, 4).mapInArrow(textops.tidied(work), "doc_id long, text string, path string, secrets array<string>")
