"""Column functions that find and redact secrets, and the capture filters."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions.text import WS, WS_RANGES, col, contains_any, literal_pattern
from recollect.functions.numbers import luhn

PREFIX = rf"(?i)\A(?:{literal_pattern(rules.TOKEN_PREFIXES)})"
HEX_TOKEN = rf"\A(?:0[xX][0-9a-fA-F]{{{rules.EVM_HEX_MIN_CHARS},}}|[0-9a-fA-F]{{{rules.HEX_MIN_CHARS},}})\z"
# Cheap look at a text before it is taken apart: could any token qualify?
TOKEN_HINT = (rf"(?i)(?<![^{WS_RANGES}])(?:{literal_pattern(rules.TOKEN_PREFIXES)}"
              rf"|0x[0-9a-f]{{{rules.EVM_HEX_MIN_CHARS}}}|[0-9a-f]{{{rules.HEX_MIN_CHARS}}})")
SPACE_EDGE = rf"(?<={WS})(?!{WS})|(?<!{WS})(?={WS})"
# Zero-width cuts before and after each maximal digit run.  Cutting, unlike one
# looped group, needs no regex recursion on very long runs.
DIGIT_RUN_EDGE = r"(?<=[0-9])(?![ -]?[0-9])|(?<![0-9])(?<![0-9][ -])(?=[0-9])"
CARD_HINT = r"[0-9](?:[ -]?[0-9]){12}"
ASCII_WORD_RUN_HINT = (rf"(?<![^{WS_RANGES}])(?:[A-Za-z]++{WS}++){{{rules.SEED_RUN_MIN_WORDS - 1}}}[A-Za-z]")


def is_secret_token(tok):
    """A credential prefix or a long hex run, on a token of 20 bytes or more."""
    return (F.octet_length(tok) >= rules.TOKEN_MIN_BYTES) & (tok.rlike(PREFIX) | tok.rlike(HEX_TOKEN))


def tokens_and_spaces(c):
    return F.split(c, SPACE_EDGE)


def scrub_tokens(c):
    """Replace credential-like tokens, keeping all white space."""
    c = col(c)
    pieces = F.transform(tokens_and_spaces(c), lambda p: F.when(
        is_secret_token(p), F.lit(rules.KEY_MARK)).otherwise(p))
    return F.when(c.rlike(TOKEN_HINT), F.array_join(pieces, "")).otherwise(c)


def is_card(piece):
    digits = F.regexp_replace(piece, "[ -]", "")
    return (piece.rlike(r"\A[0-9]")
            & F.length(digits).between(rules.CARD_MIN_DIGITS, rules.CARD_MAX_DIGITS)
            & luhn(digits))


def scrub_cards(c):
    """Replace digit runs of card length that pass the checksum."""
    c = col(c)
    pieces = F.transform(F.split(c, DIGIT_RUN_EDGE), lambda p: F.when(
        is_card(p), F.lit(rules.CARD_MARK)).otherwise(p))
    return F.when(c.rlike(CARD_HINT), F.array_join(pieces, "")).otherwise(c)


def scrub_plain(c):
    """R1 without its first stage, which needs a word list (see operators.redact)."""
    return scrub_cards(scrub_tokens(c))


def count_tokens(c):
    """Secret tokens in a text."""
    c = col(c)
    return F.when(c.rlike(TOKEN_HINT),
                  F.size(F.filter(tokens_and_spaces(c), is_secret_token))).otherwise(0)


def count_cards(c):
    """Card numbers in a text."""
    c = col(c)
    return F.when(c.rlike(CARD_HINT),
                  F.size(F.filter(F.split(c, DIGIT_RUN_EDGE), is_card))).otherwise(0)


def is_private_window(title, app):
    """Title or app names a wallet, password manager, bank or sign-in."""
    return (contains_any(F.lower(col(title)), rules.PRIVATE_WINDOW_MARKERS)
            | contains_any(F.lower(col(app)), rules.PRIVATE_WINDOW_MARKERS))


def is_blacklisted_title(title):
    """R7."""
    return contains_any(F.lower(col(title)), rules.TITLE_BLACKLIST)


def is_messenger_noise(app, title):
    """A chat app whose title shows no sign of work."""
    return (contains_any(F.lower(col(app)), rules.MESSENGER_APPS)
            & ~contains_any(F.lower(col(title)), rules.WORK_TITLE_WORDS))


def seal(c, key):
    """Encrypt a field and mark it; without a key the text passes through."""
    c = col(c)
    if key is None:
        return c
    sealed = F.concat(F.lit(rules.SEAL_MARK), F.base64(F.aes_encrypt(c, key, F.lit("GCM"))))
    # base64 may be broken into lines; stored fields are one line.
    return F.regexp_replace(sealed, r"[\r\n]", "")


def open_sealed(c, key):
    """Decrypt a marked field; unreadable gives '', unmarked passes through."""
    c = col(c)
    marked = c.startswith(rules.SEAL_MARK)
    if key is None:
        return F.when(marked, F.lit("")).otherwise(c)
    raw = F.try_to_binary(F.substring(c, len(rules.SEAL_MARK) + 1, 2 ** 31 - 1), F.lit("base64"))
    plain = F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string")
    return F.when(marked, F.coalesce(plain, F.lit(""))).otherwise(c)


def redact_log_line(c):
    """Cut a log line after the first content marker in list order."""
    c = col(c)
    out = c
    for mark in reversed(rules.LOG_CONTENT_MARKERS):
        at = F.instr(c, mark)
        out = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1),
                                      F.lit(mark.rstrip() + " […]"))).otherwise(out)
    return out
