"""Fixed values, schemas and errors shared by all layers."""

from __future__ import annotations

# Vectors, rankings and files agree only where these are equal.
DIM = 16384
SEED = 0xDEC0DE01
PRNG_PREFIX = b"DRINGv1|"
PRNG_ID = b"SHA256-CTR-V1"
FILE_VERSION = 1
MAGIC_ATOMS = b"DRINGATM"
MAGIC_TOKENS = b"DRINGTOK"
CHUNK = 16
SEQ_STRIDE = 257
DF_MAX = 0.25
RAW_SCALE, WHITE_SCALE = 25.0, 3.0
WINDOW, TOP_WINDOWS = 4, 8
MAX_SCANS, MAX_PIECES = 24, 8
GRADED_CAP = 15
SEM_BITS, SEM_WINDOW, SEM_STRIDE, SEM_DIM = 8192, 8, 4, 768
NEIGHBOUR_GAMMA, NEIGHBOUR_NATIVE_MAX = 0.4, 0.1
PHANTOM_FLOOR, TIE_WEIGHT, SEM_WEIGHT = 0.25, 0.25, 0.75
SHORTLIST, INJECTED = 1024, 256
ABSTAIN_TAU, DOC_CAP = 0.505, 2
VOLUME_TOKENS, TOKEN_BOUND, MIN_ARTICLE_CHARS = 100_000, 10_000_000, 200
#: Words that carry no weight in a question.
STOP_WORDS = tuple(
    """
a an the of in on at to for from by with as it is its this that these those and or but
what which who whom whose where when why how are was were be been being does do did has
have had can could will would should shall may might must not no yes there here then than
into onto about over under most more many much very also only such same other another each
every all any some few between you your we our i me my he his she her they them their s t
""".split()
)

#: Lossless pieces of a text: up to six word characters with the space before them, or one other character.
PIECE = r"(?: ?[\p{L}\p{N}_]{1,6})|[^\p{L}\p{N}_]"

#: Sides of joins are broadcast up to so many rows; beyond it they are shuffled.
BROADCAST_ROWS = 200_000


class QuillonError(Exception):
    pass


class StoreError(QuillonError):
    pass


class StoreVersionError(StoreError):
    pass


class SemanticError(QuillonError):
    pass
