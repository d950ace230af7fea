"""Labelled findings that the secret scan is trained on unless others are given.

The contexts and their labels are written by hand; each is filled with values of its kind from a generator with a fixed
seed, so no real secret is stored here.
"""

from __future__ import annotations

import base64
import random

from pyspark.sql import DataFrame, SparkSession

#: Values made for each context.
VALUES = 8

# What stands before a value, its kind, what stands after it, the path, and whether it is a secret.
CONTEXTS = [
    ('api client token = "', "hex40", '" # set', "src/app.py", 1), ("export API_KEY=", "mixed20", " && run", "env.sh", 1), ("the password: ", "mixed24", " was sent", "notes", 1), ('"secret": "', "base64", '",', "config.json", 1),
    ("Authorization: Bearer ", "base64", "", "http.log", 1), ("aws_secret_access_key = ", "slashed40", "", "credentials", 1), ("https://h.example/cb?access_token=", "hex32", "&page=2 then", "log", 1), ("user=joe pwd=", "mixed16", ";", "db.ini", 1),
    ("my key is ", "aws", " and it works", "chat", 1), ("clone with ", "github", " as user", "chat", 1), ("charge by ", "stripe", " today", "shop.py", 1), ("post to slack ", "slack", ".", "bot.py", 1), ("maps ", "google", "", "index.html", 1), ("npm login with ", "npm", "", "ci.yml", 1),
    ("PRIVATE_KEY='", "long", "' end", "deploy.env", 1), ("of that text token = '", "hex64", "' and more", "", 1), ("TEXT IN TOKEN = \"", "HEX40", '" MORE', "", 1), ("client credential ", "mixed32", " for login", "wiki", 1), ("passphrase -> ", "mixed20", "", "", 1),
    ("auth_token: ", "hex40", "", "values.yaml", 1), ("apikey=", "uuid", "", "settings", 1), ("session secret: '", "mixed40", "'", "app.js", 1), ("set pwd ", "mixed16", " please", "mail", 1), ("some words token = \"", "hex32", '" other words', "src1", 1), ("un mot token = \"", "hex40", '" autre', "src2", 1),
    ("ein Wort token = \"", "hex40", '" und', "src3", 1), ("api-key: ", "mixed40", "", "README", 1), ("encoded private ", "long", "", "", 1), ("bearer ", "mixed40", "", "", 1), ("DB_PASSWORD=", "mixed16", "", ".env", 1),
    ("paid by card ", "digits16", " in May", "mail", 0), ("words here ", "digits16", " and there", "", 0), ("call ", "digits12", " now", "", 0), ("ISBN ", "digits13", ", new", "books", 0), ("order no. ", "digits14", " shipped", "shop", 0), ("account ", "digits16", "", "", 0),
    ("see commit ", "hex40", " of today", "git.log", 0), ("sha256: ", "hex64", " ok", "SHA256SUMS", 0), ("md5 checksum ", "hex32", "  file.zip", "sums", 0), ("index ", "hex40", "..", "a.patch", 0), ("object id ", "uuid", " found", "log", 0), ("request ", "uuid", " took 3 ms", "log", 0), ("build digest = ", "hex64", "", "ci.log", 0),
    ("in the ", "slug", " report", "", 0), ("open ", "path", " first", "README", 0), ("link to ", "path", "", "index", 0), ("call ", "camel", " again", "a.py", 0), ("def ", "snake", "(self)", "tests/test_a.py", 0), ("run ", "snake", "", "tests", 0), ("on ", "stamp", " it began", "log", 0), ("version ", "version", " is out", "NEWS", 0),
    ("part ", "part", " fits", "catalog", 0), ("see ", "part", ",", "", 0), ("token = ", "placeholder", " # put yours", "docs/example.md", 0), ("password: ", "placeholder", "", "docs/sample", 0), ("API_KEY=", "placeholder", "", "example.env", 0), ("tokenize ", "snake", " words", "src", 0), ("the author wrote ", "slug", "", "", 0),
    ("secret of ", "slug", " told", "novel", 0), ("Text ", "digits16", ", text", "", 0), ("TEXT ", "digits16", " TEXT!!", "", 0), ("etag \"", "hex32", '"', "http.log", 0), ("page ", "digits12", "", "", 0), ("password reset on ", "stamp", "", "log", 0), ("token count ", "digits12", "", "log", 0), ("img ", "longpath", "", "index.html", 0),
]
_WORDS = "alpha report valve summer pressure engine update manual chapter winter release green table account market people letter station".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _value(kind: str, made: random.Random) -> str:
    pick = lambda n, of=_ALNUM: "".join(made.choice(of) for _ in range(n))
    words = lambda n, by: by.join(made.choice(_WORDS) for _ in range(n))
    number = lambda: str(made.randrange(1, 100))
    name, size = kind.rstrip("0123456789"), int("0" + kind.lstrip("abcdefghijklmnopqrstuvwxyzHEX"))
    match name:
        case "hex":
            return pick(size, "0123456789abcdef")
        case "HEX":
            return pick(size, "0123456789ABCDEF")
        case "mixed":
            return pick(size - 2) + pick(1, "0123456789") + pick(1)
        case "digits":
            return pick(size, "0123456789")
        case "base" | "long":
            return base64.b64encode(made.randbytes(made.randrange(20, 60) if name == "base" else made.randrange(150, 600))).decode()
        case "slashed":
            return pick(size, _ALNUM + "+/")
        case "aws":
            return "AKIA" + pick(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        case "github":
            return "ghp_" + pick(36)
        case "stripe":
            return "sk_live_" + pick(24)
        case "slack":
            return f"xoxb-{pick(12, '0123456789')}-{pick(24)}"
        case "google":
            return "AIza" + pick(35)
        case "npm":
            return "npm_" + pick(36)
        case "uuid":
            return "-".join(pick(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
        case "slug":
            return f"{words(3, '-')}-{number()}"
        case "path" | "longpath":
            return f"/{words(3 if name == 'path' else 12, '/')}-v{number()}"
        case "camel":
            return "".join(w.title() for w in words(3, " ").split()) + "V" + number()
        case "snake":
            return f"{words(3, '_')}_{number()}"
        case "stamp":
            return f"20{made.randrange(10, 30)}-{made.randrange(1, 13):02d}-{made.randrange(1, 29):02d}T{made.randrange(24):02d}"
        case "version":
            return f"release-20{made.randrange(10, 30)}-{made.randrange(1, 13):02d}-{made.choice(_WORDS)}"
        case "part":
            return made.choice(_WORDS) + pick(9, "0123456789")
        case "placeholder":
            return made.choice(["your-token-here-", "xxxxxxxxxxxxxxxx", "changeme-changeme-", "insert_your_key_", "example-password-"]) + number()
    raise ValueError(kind)


def labelled_findings(spark: SparkSession, seed: int = 7) -> DataFrame:
    """``(value, before, after, path, is_secret)``: ``VALUES`` findings of each context."""
    made = random.Random(seed)
    rows = [(_value(kind, made), before, after, path, label) for before, kind, after, path, label in CONTEXTS for _ in range(VALUES)]
    return spark.createDataFrame(rows, "value string, before string, after string, path string, is_secret int")
