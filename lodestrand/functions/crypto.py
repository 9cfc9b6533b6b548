"""What calls and statements do with keys and digests: services, SQL functions, algorithms, and whether a quantum computer breaks them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import bound

# Callable services and SQL functions with what they do, names of algorithms, key sizes.
SERVICES = {
    "CSNBOWH": "hash", "CSNBHMG": "mac-generate", "CSNBHMV": "mac-verify", "CSNBMGN": "mac-generate", "CSNBMVR": "mac-verify", "CSNBENC": "symmetric-encrypt", "CSNBDEC": "symmetric-decrypt",
    "CSNBSYE": "symmetric-encrypt", "CSNBSYD": "symmetric-decrypt", "CSNBKGN": "key-generate", "CSNBCKM": "key-import", "CSNBRNG": "random", "CSNBRNGL": "random", "CSNBPGN": "pin-generate", "CSNBPVR": "pin-verify",
    "CSNDDSG": "signature-generate", "CSNDDSV": "signature-verify", "CSNDPKG": "key-generate", "CSNDPKE": "asymmetric-encrypt", "CSNDPKD": "asymmetric-decrypt", "CSNDEDH": "key-agreement", "CSNDPKB": "key-token-build",
}
FAMILIES = ("CSNB", "CSND", "CSNE", "CSNF", "CSFP")
SAME = {"CSNE": "CSNB", "CSNF": "CSND"}
PUBLIC_KEY = "CSND"
SQL_FUNCTIONS = {
    "ENCRYPT_TDES": "symmetric-encrypt", "ENCRYPT": "symmetric-encrypt", "DECRYPT_BIT": "symmetric-decrypt", "DECRYPT_CHAR": "symmetric-decrypt", "DECRYPT_DB": "symmetric-decrypt", "DECRYPT_BINARY": "symmetric-decrypt",
    "HASH_MD5": "hash", "HASH_SHA1": "hash", "HASH_SHA256": "hash", "HASH": "hash",
}
ALGORITHMS = ((r"^RSA", "rsa"), (r"^(?:ECC|ECDSA|ECDH|EC-)", "ecc"), (r"^DSA$", "dsa"), (r"^(?:DH|DIFFIE)", "dh"), (r"^SHA-?(?:1|224|256|384|512)$", "sha-"), (r"^MD5$", "md5"), (r"^AES", "aes"), (r"^T?DES", "des"))
BROKEN = ("rsa", "ecc", "dsa", "dh")
KEY_SIZES = (1024, 2048, 3072, 4096, 8192)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def service(target: Column) -> Column:
    """(name, category) of a call's target that is a callable service, under its base name; null for others. A name of the families that isn't known is `unclassified`."""
    name = F.upper(target)
    known = list(SERVICES)
    base = F.when(name.endswith("1") & F.substring(name, F.lit(1), F.length(name) - 1).isin(known), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)
    prefix = F.substring(base, 1, 4)
    base = F.concat(F.coalesce(_looked_up(SAME, prefix), prefix), F.substring(base, F.lit(5), F.length(base)))
    return F.when(F.substring(name, 1, 4).isin(*FAMILIES), bound(base, lambda b: F.struct(b.alias("name"), F.coalesce(_looked_up(SERVICES, b), F.lit("unclassified")).alias("category"))))


def sql_functions(statement: Column) -> Column:
    """(name, category) structs of the functions of a statement that hash or encrypt, in order."""
    names = "|".join(sorted(SQL_FUNCTIONS, key=len, reverse=True))
    found = F.regexp_extract_all(statement, F.lit(rf"(?i)(?<![\w-])({names})\s*\("), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.upper(x).alias("name"), _looked_up(SQL_FUNCTIONS, F.upper(x)).alias("category")))


def algorithm(word: Column) -> Column:
    """The algorithm that a literal names, with the size of a SHA; null for other words."""
    w = F.upper(F.trim(word))
    out = F.when(F.lit(False), "")
    for pattern, name in ALGORITHMS:
        out = out.when(w.rlike(pattern), F.concat(F.lit(name), F.regexp_extract(w, "([0-9]+)$", 1)) if name == "sha-" else F.lit(name))
    return out


def use(name: Column, texts: Column, numbers: Column) -> Column:
    """(algorithm, key_bits, vulnerable) of a service that is given texts and numbers: the first text that names an algorithm, the first number that is a key size where the algorithm has such.

    Without a name nothing is known of a public-key service; all others are not what a quantum computer breaks.
    """
    first = F.get(F.filter(F.transform(texts, algorithm), lambda a: a.isNotNull()), F.lit(0))
    bits = F.get(F.filter(numbers, lambda n: n.isin(*KEY_SIZES)), F.lit(0))
    return bound(F.struct(first.alias("a")), lambda s: F.struct(
        s["a"].alias("algorithm"), F.when(s["a"].isin("rsa", "dsa", "dh"), bits).alias("key_bits"),
        F.when(s["a"].isNotNull(), s["a"].isin(*BROKEN)).when(~F.coalesce(name.startswith(PUBLIC_KEY), F.lit(False)), False).alias("vulnerable")))
