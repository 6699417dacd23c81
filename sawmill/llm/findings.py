"""Labelled findings for the secret scan: rows made by rule after public formats of secrets and of what is taken for them.

A finding is (candidate, before, after, label) as secrets.all_candidates gives them; a table of the same columns replaces these rows. Formats,
contexts and their pairing are drawn at random from a fixed seed. A part of the rows has a context that says nothing, or the
context of the other kind, so that neither format nor context alone decides.
"""

from __future__ import annotations

import base64
import random
import uuid
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits, hexdigits

HEX, ALNUM, BASE64 = hexdigits[:16], ascii_letters + digits, ascii_letters + digits + "+/"

WORDS = (
    "account address agent archive block branch bridge button cache canvas carbon catalog center channel circle client cloud column copper corner cover daily delta design detail doctor double driver eastern editor engine "
    "entry evening field figure filter final finger forest format frame garden global golden green handle harbor header holder house image index island kitchen ladder laptop letter level light linear list local lunar market matter "
    "member metal middle minute mirror module monday morning motion mountain native network normal notice number object office orange order output owner packet page paper parent pattern people picture planet player pocket point "
    "policy portal primary printer profile project public purple quick radio random record region remote report result river rocket router sample screen second section sector sensor series server shadow signal silver simple single "
    "sketch smart socket source spring square stable stage station status storage store story stream street string studio summer sunday supply switch system table target team ticket timber tower track travel tunnel union update upper "
    "user valley value vector video view village vision voice walker water weather week western white window winter wonder yellow"
).split()
FILLERS = "the of and in to is by at on for with from that this was as it be are or a an we you der die und in den von zu das mit sich la le de et les des en un une el los que y se del las".split()
#: What stands before and after: names of secrets, names of harmless things, and plain text.
SECRET_BEFORE = [
    "password: ", "passwd = '", 'password="', "pwd=", "db_password: ", "secret = ", 'client_secret: "', "secret_key = '", "api_key = ", 'apikey: "', "API_KEY=", "token: ", 'access_token = "', "auth_token=", "refresh_token: ", "bearer ",
    "Authorization: Bearer ", "Authorization: Basic ", "credentials: ", "private key ", "aws_secret_access_key = ", "export GITHUB_TOKEN=", "X-Api-Key: ", "my passphrase is ", "login with ", "the key to the vault is ", "signing key: ",
    "connection string: ", "webhook secret ", "otp seed ", "Passwort: ", "mot de passe : ", "contraseña: ",
]
PLAIN_BEFORE = [
    "commit ", "at revision ", "sha256 ", "md5 checksum: ", "digest: ", "uuid ", "request id ", "trace id: ", "order number ", "invoice ", "serial no. ", "isbn ", "call ", "phone ", "version ", "see ", "in ", "open ", "file ", "path: ", "at ", "host ",
    "from ", "host: ", "url = ", 'href="', "build ", "release ", "ticket ", "part number ", "model ", "since ", "on ", "dated ", "color: #", "etag: ", "session log ", "object id ", "color ", "product code ", "example: ", "sample ", "test vector ", "blob ",
    "image hash ", "doi ", "article ", "Bestellung ", "numéro ", "pedido ",
]
NEUTRAL = ["and then ", "the ", "it was ", "", "we found ", "here is ", "value ", "note: ", "(", "- ", "ändert ", "avec ", "para ", "\n"]
SECRET_AFTER = ["' # keep private", '"', '";', " do not share", "\n", " in the vault", "', user=", " expires", "\n-----END", " as the credential", "", " and"]
PLAIN_AFTER = [" was merged", " is the checksum", " matches", ".", ", see", " for details", " shipped", " and the", "\n", " on disk", "", " by phone", " was released", " in the log"]

Finding = tuple[str, str, str, int]


def _words(r: random.Random, n: int, join: str = "") -> str:
    return join.join(r.choice(WORDS) for _ in range(n))


def _of(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def _secret(r: random.Random) -> tuple[str, bool]:
    """(a secret, whether its own form says so)."""
    kind = r.randrange(16)
    if kind == 0:
        return r.choice(["AKIA", "ASIA"]) + _of(r, ascii_uppercase + "234567", 16), True
    if kind == 1:
        return "gh" + r.choice("pousr") + "_" + _of(r, ALNUM, 36), True
    if kind == 2:
        return "xox" + r.choice("bap") + "-" + "-".join(_of(r, digits, r.randint(10, 13)) for _ in range(2)) + "-" + _of(r, ALNUM, 24), True
    if kind == 3:
        return r.choice(["sk_live_", "sk-"]) + _of(r, ALNUM, r.choice([24, 32, 48])), True
    if kind == 4:
        return "AIza" + _of(r, ALNUM + "-_", 35), True
    if kind == 5:
        part = lambda n: base64.urlsafe_b64encode(r.randbytes(n)).decode().rstrip("=")
        return "eyJ" + part(24) + ".eyJ" + part(r.randint(30, 60)) + "." + part(32), True
    if kind in (6, 7):
        return _of(r, HEX, r.choice([20, 24, 32, 32, 40, 48, 64, 64, 128])), False
    if kind in (8, 9):
        return _of(r, ALNUM, r.choice([12, 16, 20, 22, 24, 32, 40, 64])), False
    if kind == 10:
        return base64.b64encode(r.randbytes(r.choice([16, 24, 30, 32, 48]))).decode(), False
    if kind == 11:
        return _of(r, ascii_letters, r.choice([16, 24, 32, 40])), False
    if kind == 12:
        return "".join(w.capitalize() for w in _words(r, r.randint(2, 4), " ").split()) + r.choice(["", _of(r, digits, r.randint(1, 4))]), False
    if kind == 13:
        return _of(r, ALNUM + "_-.+=", r.randint(6, 14)), False
    if kind == 14:
        leet = _words(r, 2).translate(str.maketrans("aeios", "43105"))
        return leet + _of(r, digits, r.randint(0, 3)), False
    return r.choice(["password=", "token=", "secret_key=", "api-key=", "auth="]) + _of(r, r.choice([HEX, ALNUM]), r.choice([16, 18, 24, 32])), True


def _harmless(r: random.Random) -> tuple[str, bool]:
    """(what is taken for a secret, whether its own form says that it is none)."""
    kind = r.randrange(20)
    if kind in (0, 1):
        return _of(r, HEX, r.choice([7, 12, 32, 40, 40, 64])), False
    if kind == 2:
        return str(uuid.UUID(int=r.getrandbits(128))), True
    if kind == 3:
        return "/" + "/".join(_words(r, 1) for _ in range(r.randint(2, 5))) + r.choice(["", ".log", ".txt", ".py", "2.csv", ".7z"]), True
    if kind == 4:
        return "/".join(_words(r, 1) for _ in range(r.randint(2, 4))) + "/" + _of(r, digits, r.randint(1, 5)), True
    if kind == 5:
        return _words(r, r.randint(1, 2), "-") + r.choice([".com", ".org", ".example.net", ".io"]) + "/" + _words(r, 1) + "/" + _of(r, digits, 4), True
    if kind == 6:
        return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(["", f"T{r.randint(0, 23):02d}"]), True
    if kind == 7:
        return _of(r, digits, r.choice([12, 13, 16, 20])), True
    if kind == 8:
        return "-".join(_of(r, digits, r.randint(2, 5)) for _ in range(r.randint(3, 5))), True
    if kind == 9:
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), True
    if kind == 10:
        return _words(r, 1) + "-" + ".".join(str(r.randint(0, 30)) for _ in range(3)) + r.choice([".tar.gz", ".jar", "-beta.1", ""]), True
    if kind == 11:
        return _words(r, r.randint(2, 3), "_") + "_" + _of(r, digits, r.randint(1, 3)), True
    if kind == 12:
        w = _words(r, r.randint(2, 4), " ").split()
        return w[0] + "".join(x.capitalize() for x in w[1:]) + r.choice(["", _of(r, digits, 1)]), True
    if kind == 13:
        return "-".join(r.choice(WORDS) for _ in range(r.randint(2, 4))), True
    if kind == 14:
        return r.choice(["AKIA", "sk_live_", "ghp_"]) + r.choice(["EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000", "EXAMPLEKEY1234567"]), True
    if kind == 15:
        return _of(r, ascii_uppercase, r.randint(2, 4)) + "-" + _of(r, digits, r.randint(5, 9)) + r.choice(["", "-" + _of(r, ascii_uppercase, 2)]), True
    if kind == 16:
        return r.choice(["changeme", "null", "none", "required", "optional", "string", "true", "abc", "see", "your_password_here", "xxxxxx", "********"]), True
    if kind == 17:
        return r.choice(WORDS), True
    if kind == 18:
        return "=" * r.randint(12, 40) + r.choice(["1", "2", ""]), True
    return "x".join(_of(r, digits, r.randint(3, 5)) for _ in range(2)) + "." + _of(r, ascii_lowercase, 3) + _of(r, digits, 4), True


def labelled(n: int, seed: int) -> list[Finding]:
    """n findings, about half of them secrets, the same on every machine."""
    r, out = random.Random(seed), []
    for _ in range(n):
        label = r.randrange(2)
        candidate, clear = (_secret if label else _harmless)(r)
        mine, other = (SECRET_BEFORE, PLAIN_BEFORE) if label else (PLAIN_BEFORE, SECRET_BEFORE)
        x = r.random()
        # a form that says nothing needs its own context; a clear one may stand anywhere
        before = r.choice(mine) if x < 0.6 or not clear else r.choice(NEUTRAL) if x < 0.85 else r.choice(other)
        after = r.choice((SECRET_AFTER if label else PLAIN_AFTER) if r.random() < 0.7 else NEUTRAL)
        lead, tail = (" ".join(r.choice(r.choice((WORDS, FILLERS))) for _ in range(r.randint(0, 6))) for _ in range(2))
        out.append((candidate, f"{lead} {before}"[-32:], f"{after} {tail}"[:32], label))
    return out
