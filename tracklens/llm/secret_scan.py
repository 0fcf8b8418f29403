"""Secret scanning: candidates by pattern, false positives removed by a random forest.

DataFrame functions and Spark ML only: no Python runs on the executors.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
RUN = r"[A-Za-z0-9_+/.\-]"
MIN_LONG, MIN_NAMED = 16, 8
#: A run of key characters; equal signs pad it unless a value follows them.
KEY_RUN = rf"{RUN}{{{MIN_NAMED},}}(?:={{1,2}}(?![=>\"'(\[{{<$]*{RUN})(?!=))?"
#: Other characters of passwords, and values that hold some of them: all between quotes, or up to what ends a field.
#: All loops are over single characters or possessive, so that words of any length are matched without deep calls.
MARKS = r"!#$%^*~?|@:\\"
QUOTED = "|".join(
    rf"(?<={q})(?=[A-Za-z0-9_+/.\-=]*[^A-Za-z0-9_+/.\-={q}])[^{q}\n]{{{MIN_NAMED},}}(?={q})" for q in "\"'")
BARE = (
    rf"(?![\w+.\-]+://)(?=[A-Za-z0-9_+/.\-=]*[&{MARKS}][A-Za-z0-9_+/.\-=&{MARKS}]*[A-Za-z0-9])"
    rf"(?:[A-Za-z0-9_+/.\-={MARKS}]|&(?![\w\-]+=)){{{MIN_NAMED},}}+")
#: A private key: its first line, its body up to the next row of five hyphens, its last line. ``INNER`` stands for its
#: white space where the whole block is made one word.
INNER = "\x1f"
KEY_NAME = r"[A-Z0-9 \x1f]{0,40}PRIVATE[ \x1f]KEY(?:[ \x1f]BLOCK)?-----"
KEY_HEAD, KEY_BODY, KEY_END = rf"-----BEGIN[ \x1f]{KEY_NAME}", r"(?:[^-]|-(?!----))*+", rf"-----END[ \x1f]{KEY_NAME}"
#: What ends a field inside a word, and how many characters of a word's head and of the words before its later runs see.
FIELD_ENDS, HEAD = ",;&{}", 200
# Words that name a credential, words that name something harmless, path parts.
SECRET_WORDS = (
    "token|secret|passw|passwd|pwd|api[_-]?key|apikey|auth|credential|private[_-]?key|access[_-]?key|"
    "client[_-]?key|signing[_-]?key|bearer|session[_-]?key|encryption[_-]?key")
HARMLESS_WORDS = (
    "sha[0-9]*|md5|commit|checksum|digest|uuid|guid|hash|revision|version|build|isbn|phone|card|order|invoice|"
    "example|sample|dummy|placeholder|fingerprint|etag|trace|request")
TEST_PATHS = "test|spec|example|sample|fixture|mock|docs?/|readme"
DICTIONARY = (
    "the and for that with this from have not are was you your here key api token secret password passwd user name "
    "admin test demo example sample dummy placeholder change changeme replace insert enter value string config "
    "default file path data http https www com org net html json yaml index page home image photo document "
    "license version commit build release order number phone account customer order invoice message session "
    "public private local host server client service access code hash check update install package module class "
    "function return true false null none read write open close first last next new old").split()
# Forms of the tokens that services issue, and programs that take a password right behind -p.
TOKEN_FORMS = (
    r"^(gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{20,}|npm_[A-Za-z0-9]{36}|(AKIA|ASIA)[A-Z0-9]{16}|AIza[\w\-]{35}|"
    r"xox[abprs]-[A-Za-z0-9\-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{16,})$")
FLAG_PROGRAMS = r"\b(mysql|mysqldump|mysqladmin|mariadb|sshpass)\b"
FEATURES = [
    "length", "changes", "distinct", "digits", "uppers", "symbols", "vowels", "hexadecimal", "numeric", "dictionary",
    "repeats", "named", "assigned", "quoted", "harmless", "slashes", "dots", "address", "in_test_path", "after_words",
    "token_form", "key_body", "flagged", "marks", "plain_words"]
#: Labelled findings that the forest is fitted on, its trees and their depth.
FIT_FINDINGS, TREES, DEPTH, SEED = 3_000, 40, 7, 13
THRESHOLD = 0.5


def _classes(core: Column) -> Column:
    """Every lower letter as a, upper letter as A, digit as 0, anything else as it is."""
    for pattern, to in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")):
        core = F.regexp_replace(core, pattern, to)
    return core


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Every run of key characters that may hold a secret:
    ``id, word_no, run_no, core, before, prefix, after, path``.

    A word may hold any number of runs of ``MIN_NAMED`` key characters or more, counted by ``run_no``; each is
    judged alone. It is a candidate with 16 characters or more and a digit or both letter cases in it, or with
    8 or more where a word that names a credential and an assignment sign stand right before it. A value that holds other
    characters there (:data:`QUOTED`, :data:`BARE`, without white space) is one run. The body of a private key is one run too: its
    block, which ends with its last line, counts as one word, and ``core`` is the body without white space and written-out line
    ends; blocks without a last line are read as other text. Behind ``-p`` of :data:`FLAG_PROGRAMS` the core begins after the flag.

    ``prefix`` of the first run is all of the word before it. A later run has the field that it stands in,
    from the run before it on; a field without an assignment sign (an item of a list) follows the word's head, and only a
    field with one hides the words before, of which later runs see the last ``HEAD`` characters. ``after`` is the rest of the field, or the next word if the word ends
    without more key characters. So the columns of all runs of a word are together no longer than a few words.
    """
    block = f"{KEY_HEAD}{KEY_BODY}{KEY_END}"
    glued = F.array_join(F.zip_with(
        F.split("text", block), F.regexp_extract_all("text", F.lit(block), F.lit(0)),
        lambda other, held: F.concat(other, F.regexp_replace(F.coalesce(held, F.lit("")), SPACE, INNER))), "")
    words = F.split(F.when(F.contains(F.col("text"), F.lit("-----BEGIN")), glued).otherwise(F.col("text")), SPACE)
    long_run = rf"{RUN}{{{MIN_LONG},}}"
    named = rf"(?i)({SECRET_WORDS})[\w\-]*[\"']?\s*(=|:|=>|is)"
    value = (
        rf"((?i:^\t[\"'(\[]*|(?<![\w\-.])[\w\-.]{{0,64}}?(?:{SECRET_WORDS})[\w\-]{{0,64}}[\"']?(?::=|=>|[=:])[\"']?)|{KEY_HEAD})"
        rf"((?<=-----){KEY_BODY}(?=-----END)|(?!-----BEGIN)(?:{QUOTED}|{BARE}))")
    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"),
        (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"),
    ).filter(F.col("text").rlike(long_run) | F.col("text").rlike(rf"{named}|\s-p\w")).withColumn("words", words)
    w = F.col("words")
    before = lambda i: F.array_join(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
    possible = F.filter(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.get(w, i).rlike(long_run) | (
            (F.length(F.get(w, i)) >= MIN_NAMED)
            & (F.concat_ws(" ", F.when(i > 0, before(i)), F.get(w, i)).rlike(named)
               | F.get(w, i).rlike("^-p[^-]") & before(i).rlike(rf"(?i){FLAG_PROGRAMS}"))))
    found = rows.select(
        "id", "path",
        F.explode(F.transform(possible, lambda i: F.struct(
            i.alias("word_no"), F.get(w, i).alias("word"), F.when(i > 0, before(i)).otherwise("").alias("before"),
            F.coalesce(F.get(w, i + 1), F.lit("")).alias("after")))).alias("c"))
    # A line feed is in no word: it marks where runs begin and end, so pieces 1, 3, 5 ... from 0 are the runs.
    # A tab before a word tells that a credential's name and an assignment sign stand right before it.
    lead = F.when(F.col("before").rlike(named + r"\s*$"), F.lit("\t")).otherwise("")
    marked = F.regexp_replace(F.concat(lead, "word"), f"{value}|({KEY_RUN})", "$1\n$2$3\n")
    found = found.select("id", "path", "c.*").withColumn(
        "pieces", F.split(F.regexp_replace(marked, "^(\n?)\t", "$1"), "\n")).withColumns(
        {"head": F.right(F.get("pieces", F.lit(0)), F.lit(HEAD)), "close": F.right("before", F.lit(HEAD))})
    pieces = F.col("pieces")
    found = found.filter(F.size(pieces) > 1).select(
        "id", "path", "word_no", "head",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda p: F.struct(
                ((p - 1) / 2).cast("int").alias("run_no"), F.get(pieces, p).alias("run"),
                F.when(p == 1, F.col("before")).otherwise(F.col("close")).alias("before"),
                F.when(p == F.size(pieces) - 2, F.col("after")).otherwise("").alias("after"),
                F.array_join(F.slice(pieces, F.greatest(p - 2, F.lit(1)), F.least(p, F.lit(3))), "").alias("ahead"),
                F.concat(F.get(pieces, p + 1), F.coalesce(F.get(pieces, p + 2), F.lit(""))).alias("tail")))).alias("r")
    ).select("id", "path", "word_no", "head", "r.*")
    own = F.regexp_extract("ahead", rf"[^{FIELD_ENDS}]*$", 0)
    first, whole = F.col("run_no") == 0, F.length(own) == F.length("ahead")
    assigned = own.rlike("[=:]")
    in_block, quoted = F.col("ahead").rlike(f"{KEY_HEAD}$"), F.col("ahead").rlike("[\"']$")
    only_key = F.col("run").rlike(rf"^{RUN}+=*$")
    flag = only_key & F.col("run").rlike("^-p[^-]") & F.concat_ws(" ", "before", "ahead").rlike(rf"(?i){FLAG_PROGRAMS}")
    strip = F.when(in_block | ~only_key, "").when(flag, "-p").otherwise(F.regexp_extract("run", r"^[.\-/]*", 0))
    rest = F.substr("run", F.length(strip) + 1)
    core = (
        F.when(in_block, F.regexp_replace("run", INNER + r"|\\[nrt]", ""))
        .when(only_key, F.regexp_replace(rest, r"[.\-/]+$", ""))
        .when(quoted, F.col("run")).otherwise(F.regexp_replace("run", r"[.:?]+$", "")))
    found = found.select(
        "id", "path", "word_no", "run_no", core.alias("core"),
        F.when(first | whole | ~assigned, F.col("before")).otherwise("").alias("before"),
        F.concat(
            F.when(first, F.col("ahead")).when(assigned, own).otherwise(F.concat("head", own)),
            strip).alias("prefix"),
        F.when(F.col("tail").rlike(r"[A-Za-z0-9_+/.\-=]"), F.regexp_extract("tail", rf"^[^{FIELD_ENDS}]*", 0))
        .otherwise(F.col("after")).alias("after"))
    near = F.concat_ws(" ", "before", "prefix")
    mixed = F.col("core").rlike("[0-9]") | (F.col("core").rlike("[a-z]") & F.col("core").rlike("(?<!^)[A-Z]"))
    return found.filter(
        (F.length("core") >= MIN_NAMED)
        & (((F.length("core") >= MIN_LONG) & mixed) | near.rlike(rf"(?i){FLAG_PROGRAMS}.* -p$") | near.rlike(named + r"[\"'(\[]*$") | near.rlike(named + r"\s*[\"'(\[]*$"))
    ).select("id", "word_no", "run_no", "core", "before", "prefix", "after", "path")


def with_features(found: DataFrame) -> DataFrame:
    """Length, character transitions, dictionary coverage, path and neighbouring words of candidates."""
    core, near = F.col("core"), F.lower(F.concat_ws(" ", "before", "prefix"))
    size = F.length("core").cast("double")

    def share(pattern: str, of: Column = core) -> Column:
        return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))) / size

    runs = F.length(F.regexp_replace(_classes(core), r"(.)\1+", "$1"))
    covered = F.regexp_replace(F.lower(core), "|".join(sorted(set(DICTIONARY), key=lambda x: (-len(x), x))), "")
    address = F.concat("prefix", "core", "after")
    columns = {
        "length": F.least(size, F.lit(200.0)),
        "changes": (runs - 1) / F.greatest(size - 1, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / F.least(size, F.lit(64.0)),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"),
        "vowels": share("(?i)[aeiou]"),
        "hexadecimal": core.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "numeric": core.rlike(r"^[0-9.\-/+]+$").cast("double"),
        "dictionary": 1 - F.length(covered) / size,
        "repeats": share(r"(.)\1{2,}"),
        "named": near.rlike(SECRET_WORDS).cast("double"),
        "assigned": near.rlike(r"(=|:|=>)\s*[\"'(\[]*$").cast("double"),
        "quoted": F.col("prefix").rlike(r"[\"'`]$").cast("double"),
        "harmless": near.rlike(HARMLESS_WORDS).cast("double"),
        "slashes": share("/"), "dots": share(r"\."),
        "address": (address.rlike(r"@|://|www\.") | core.rlike(r"\.(com|org|net|html?|js|py|png|jpe?g)\b")).cast("double"),
        "in_test_path": F.coalesce(F.lower("path").rlike(TEST_PATHS), F.lit(False)).cast("double"),
        "after_words": F.col("after").rlike("^[a-z]").cast("double"),
        "token_form": core.rlike(TOKEN_FORMS).cast("double"),
        "key_body": F.col("prefix").rlike(f"{KEY_HEAD}$").cast("double"),
        "flagged": near.rlike(rf"{FLAG_PROGRAMS}.* -p$").cast("double"),
        "marks": share(f"[&{MARKS}]"),
        "plain_words": (~core.rlike(r"[0-9]|[A-Z](?=[A-Z])|[a-z][A-Z]|[^A-Za-z_.\-]")).cast("double"),
    }
    return found.withColumns(columns)


def labelled_findings(spark: SparkSession, n: int = FIT_FINDINGS, seed: int = SEED) -> DataFrame:
    """Findings with a label, made by rule: credentials of usual shapes where code and notes hold them, and
    what scanners take for them (digests, ids, numbers, addresses, placeholders, long words). To these ``n`` a tenth
    is added of what stands inside addresses, and two thirds of issued tokens, private keys, passwords with marks and behind flags, and what
    looks like them (plain words, references to variables, mail addresses, times, tokens blanked out)."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice("bcdfghlmnprstw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(0, 3)))
    names = "token secret password passwd api_key apikey auth_token client_secret access_key private_key credential API_KEY TOKEN db_password".split()
    harmless = "sha256 md5 commit checksum digest uuid etag revision build order isbn version hash".split()
    paths = ["src/app", "config/prod", "deploy", "src3", "web", None]
    test_paths = ["tests/unit", "docs/example", "fixtures", "README"]
    placeholders = "your-api-key-here changeme_changeme example-token-value xxxxxxxxxxxxxxxxxxxx replace_with_your_secret insert-password-here test_test_test_test 0000000000000000 1234567890123456".split()
    rows = []
    for _ in range(n):
        path = rng.choice(paths)
        after = rng.choice((plain(), "", ";", ")"))
        if rng.random() < 0.5:
            core = rng.choice((
                lambda: draw(hexa, rng.choice((32, 40, 40, 48, 64))), lambda: draw(hexa, 40).upper(),
                lambda: draw(alnum, rng.randint(16, 48)), lambda: draw(alnum + "+/", 43) + "=",
                lambda: "AK" + draw(alnum[:26] + alnum[52:], 18), lambda: rng.choice(("gh_", "sk_live_", "xoxb-")) + draw(alnum, 30),
                lambda: draw(alnum + "_-", rng.randint(10, 24))))()
            near = f"{rng.choice(names)}{rng.choice(('_prod', '', '', ''))}"
            shape = rng.random()
            if shape < 0.45:
                before, prefix = f"{plain()} {near} {rng.choice(('=', ':', '=>'))}", rng.choice(('"', "'", ""))
            elif shape < 0.8:
                before, prefix = plain(), near + rng.choice(("=", ":", '="', ":'"))
            elif shape < 0.9:
                before, prefix = f"Authorization: {rng.choice(('Bearer', 'Token'))}", ""
            else:
                before, prefix = f"{plain()} {near}:", rng.choice(('"', ""))
            rows.append((core, before.strip(), prefix, after.split(" ")[0], path, 1.0))
            continue
        kind = rng.randrange(8)
        before, prefix = plain(), ""
        if kind == 0:  # digests and ids named as such
            core = rng.choice((draw(hexa, rng.choice((16, 32, 40, 64))), draw(hexa, 40).upper(), draw(alnum, rng.randint(16, 44))))
            before = f"{plain()} {rng.choice(harmless)} {rng.choice((':', '=', '', 'is'))}"
            prefix = rng.choice(("", '"'))
        elif kind == 1:  # bare digests in prose
            core = rng.choice((draw(hexa, rng.choice((16, 32, 40))), draw(alnum, rng.randint(16, 60))))
        elif kind == 2:
            core = draw("0123456789", rng.randint(16, 20))
        elif kind == 3:
            core, prefix = f"mail{rng.randint(1, 99)}.{word()}{word()}.com", f"{word()}.{rng.randint(1, 99)}@"
        elif kind == 4:
            core, prefix = f"www.{word()}{word()}.org/{word()}/{rng.randint(1, 9999)}/{word()}", rng.choice(("http:", "https:", ""))
        elif kind == 5:  # placeholders
            core = rng.choice(placeholders)
            before, prefix = f"{plain()} {rng.choice(names)} =", rng.choice(('"', ""))
        elif kind == 6:  # long words and names of code
            core = rng.choice(("", "_", "-")).join((word() + word()).title() if rng.random() < 0.5 else word() + word() for _ in range(4)) + rng.choice(("", "2", "_v1"))
            if rng.random() < 0.2:
                before = f"{plain()} {rng.choice(names)} ="
        else:  # anything in tests
            core, path = draw(alnum, rng.randint(16, 40)), rng.choice(test_paths)
            before, prefix = f"{rng.choice(names)} =", '"'
        rows.append((core, before.strip(), prefix, after.split(" ")[0], path, 0.0))
    rng = random.Random(seed + 1)  # the helpers draw from this one now
    for _ in range(n // 10):  # inside addresses: passwords of connection strings, and ports with paths
        scheme, path = rng.choice("postgres mysql redis mongodb amqp http https ftp".split()), rng.choice(paths)
        if rng.random() < 0.5:
            core = rng.choice((draw(hexa, rng.choice((16, 20, 32, 40))), draw(alnum, rng.randint(16, 40)), draw(alnum + "_-", rng.randint(16, 24))))
            prefix = f"{scheme}://{rng.choice((word(), word(), ''))}:"
            rows.append((core, plain(), prefix, f"@{word()}{rng.choice(('', '.' + word()))}{rng.choice((':5432', ''))}/{word()}", path, 1.0))
        else:
            core = f"{rng.randint(80, 9999)}/{word()}{word()}/{word()}{rng.choice(('', '.html', '/' + str(rng.randint(1, 99999))))}"
            rows.append((core, plain(), f"{scheme}://{word()}:", rng.choice(("", plain().split(" ")[0])), path, 0.0))
    rng = random.Random(seed + 2)
    upper, marks = alnum[:26] + alnum[52:], "!#$%^*~?|@:&"
    shuffled = lambda x: "".join(rng.sample(x, len(x)))
    forms = (
        lambda: f"gh{rng.choice('opsur')}_" + draw(alnum, 36), lambda: rng.choice(("AKIA", "ASIA")) + draw(upper, 16),
        lambda: "glpat-" + draw(alnum + "_-", 20), lambda: "npm_" + draw(alnum, 36), lambda: "AIza" + draw(alnum + "_-", 35),
        lambda: f"xox{rng.choice('abprs')}-" + draw("0123456789", 12) + "-" + draw(alnum, 24),
        lambda: rng.choice(("sk_live_", "rk_live_")) + draw(alnum, 24), lambda: "github_pat_" + draw(alnum, 22) + "_" + draw(alnum, 40),
        lambda: ".".join(("eyJ" + draw(alnum, 33), "eyJ" + draw(alnum + "_-", rng.randint(30, 120)), draw(alnum + "_-", 43))))
    leet = lambda: "".join(rng.choice((c, c.upper(), {"e": "3", "a": "4", "o": "0", "i": "1"}.get(c, c))) for c in word() + word() + word()) + str(rng.randint(0, 999))
    for _ in range(n * 2 // 3):
        path, after, kind = rng.choice(paths), rng.choice((plain().split(" ")[0], "", ";", ")")), rng.randrange(10)
        named_before, named_prefix = rng.choice((
            (f"{plain()} {rng.choice(names)} {rng.choice(('=', ':', 'is'))}", rng.choice(("", '"', "'"))), (f"{plain()} {rng.choice(names)}:", rng.choice(("", '"'))),
            (plain(), rng.choice(names) + rng.choice(("=", ":", '="', "='")))))
        bare_before, bare_prefix = rng.choice(((plain(), ""), (plain(), rng.choice(("(", "'", '"', f"{word()}=", f"{word()}:"))), (named_before, named_prefix)))
        label = 1.0
        if kind < 2:
            core, before, prefix = rng.choice(forms)(), bare_before, bare_prefix
        elif kind < 4:
            core = shuffled(draw(marks, rng.randint(1, 4)) + draw("0123456789", rng.randint(1, 4)) + draw(alnum, rng.randint(5, 14)))
            before, prefix = named_before, named_prefix
            if rng.random() < 0.3:
                core = leet() + rng.choice(marks) + leet()
        elif kind == 4:
            head = f"-----BEGIN {rng.choice(('RSA ', 'EC ', '', 'OPENSSH ', 'ENCRYPTED '))}PRIVATE KEY-----".replace(" ", INNER)
            core, before, prefix, after = "MII" + draw(alnum + "+/", rng.randint(100, 1600)) + rng.choice(("", "=", "==")), plain(), rng.choice(("", '"')) + head, ""
        elif kind == 5:
            core, before, prefix = rng.choice((leet, lambda: draw(alnum, rng.randint(8, 20))))(), f"{rng.choice(('mysql', 'mysqldump', 'mariadb', 'sshpass'))} -u{word()}", "-p"
            if rng.random() < 0.5:
                before, prefix = named_before, named_prefix
        else:
            label, before, prefix = 0.0, named_before, named_prefix
            core = rng.choice((
                lambda: word() + word() + rng.choice(("", word())), lambda: "abcdefghijklmnop"[: rng.randint(8, 16)],
                lambda: rng.choice(("", "_", "-")).join((rng.choice(DICTIONARY), rng.choice(DICTIONARY), word())), lambda: "12345678901234"[: rng.randint(8, 14)],
                lambda: "$" + rng.choice(names).upper() + rng.choice(("", "_" + word().upper())), lambda: f"{word()}.{word()}{rng.randint(1, 99)}@{word()}{word()}.com",
                lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}.{rng.randint(100, 999)}", lambda: f"{rng.choice(('settings', 'config', 'self', 'os'))}.{word()}.{rng.choice(names)}",
                lambda: rng.choice(("ghp_", "AKIA", "sk_live_", "glpat-")) + rng.choice("xX0") * rng.choice((16, 20, 36)),
                lambda: f"{rng.choice(('your', 'example', 'changeme', 'dummy', 'replace', 'test'))}{rng.choice('-_!:')}{rng.choice(names)}{rng.choice(('', '!', '123', '-here'))}"))()
            if kind == 9:
                core, before, prefix = rng.choice((
                    lambda: "-".join(word() for _ in range(4)) + str(rng.randint(1, 99)), lambda: draw(alnum, 2) + "." + draw(alnum, rng.randint(14, 30)),
                    lambda: "AK" + draw(upper, rng.randint(10, 14)) + "EXAMPLE", lambda: draw(upper, rng.randint(16, 24))))(), *rng.choice(((plain(), ""), (plain(), "(")))
        rows.append((core, before.strip(), prefix, after, path, label))
    schema = "core string, before string, prefix string, after string, path string, label double"
    return spark.createDataFrame(rows, schema)


def fit_forest(labelled: DataFrame) -> RandomForestClassificationModel:
    """The forest over :data:`FEATURES` of findings with a 0/1 ``label``."""
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled))
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32
    ).fit(table.select("features", "label").coalesce(1))


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = "source",
    model: RandomForestClassificationModel | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per candidate: ``key, word_no, run_no, secret, n_chars, score, is_secret, core_sha256``.

    ``word_no`` counts the text's words from 0 and ``run_no`` the word's runs of key characters; ``score`` is the forest's probability and ``is_secret`` tells
    whether it reaches ``threshold``. A narrow pass over whole texts without any shuffle.

    Null and empty texts have no candidates; null keys and repeated rows are scanned like others; without
    ``path`` that feature is 0; other columns are ignored; an empty table gives an empty result.
    """
    model = model or fit_forest(labelled_findings(docs.sparkSession))
    found = with_features(candidates(docs, key, text, path))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(
        F.col("id").alias(key), F.col("word_no").cast("bigint").alias("word_no"), F.col("run_no").cast("bigint").alias("run_no"),
        F.col("core").alias("secret"),
        F.length("core").cast("bigint").alias("n_chars"), "score", (F.col("score") >= threshold).alias("is_secret"),
        F.sha2(F.col("core").cast("binary"), 256).alias("core_sha256"))
