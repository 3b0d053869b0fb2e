"""Fixed values.

Everything in this module is data that has to equal the published behaviour
for results to be right: word lists, format tables, magics, limits.
"""

# Ordered category rules (first rule with any hit wins).
CATEGORY_RULES = [
    ("characters", ["face", "portrait", "chara", "character", "npc", "pc_", "event/ch", "bust"]),
    ("monsters", ["enemy", "monster", "ene", "foe", "boss"]),
    ("ui", ["ui", "menu", "window", "frame", "cursor", "button", "layout"]),
    ("icons", ["icon", "item", "skill", "equip", "status"]),
    ("maps", ["map", "floor", "atlas", "compass"]),
    ("dungeon", ["dungeon", "mori", "labyrinth", "field", "wall", "ground", "floor", "bg3d"]),
    ("backgrounds", ["background", "back", "bg/", "eventbg", "town", "shop"]),
    ("effects", ["effect", "eff", "particle", "magic"]),
    ("fonts", ["font", "glyph", "letter"]),
]
CATEGORY_DEFAULT = "misc"

# Pixel formats as (id, name, bits per pixel, stores alpha).
FORMATS = [
    (0, "rgba8", 32, True),
    (1, "rgb8", 24, False),
    (2, "rgba5551", 16, True),
    (3, "rgb565", 16, False),
    (4, "rgba4", 16, True),
    (5, "la8", 16, True),
    (6, "hilo8", 16, False),
    (7, "l8", 8, False),
    (8, "a8", 8, True),
    (9, "la4", 8, True),
    (10, "l4", 4, False),
    (11, "a4", 4, True),
    (12, "etc1", 4, False),
    (13, "etc1a4", 8, True),
]
MAX_DIMENSION = 4096
STORAGE_ALIGN = 8

# Evidence confidence, lowest to highest.
CONFIDENCE = ["candidate", "structural", "runtime_verified", "user_verified"]
VERIFIED_RANK = 2

# File selection.
CANDIDATE_EXTENSIONS = [
    "hpi", "hpb", "stex", "bch", "bcres", "bcmdl", "cmb", "ctpk", "ctxb", "bam", "bam2", "farc", "epl",
]
CANDIDATE_MAGICS = ["STEX", "BCH\0", "CGFX", "ATBC", "CTPK", "CTXB", "ctxb", "cmb ", "FARC"]
DIRECT_MAGICS = ["STEX", "BCH\0", "CGFX", "CTPK", "CTXB", "ctxb", "cmb "]
WRAPPER_MAGIC = "ATBC"
WRAPPED_NEEDLES = ["CGFX", "BCH\0"]
EMBEDDED_NEEDLE = "BCH\0"
SIGNATURE_EXTENSIONS = [
    "bam", "bam2", "bch", "bcres", "bcmdl", "cmb", "model", "bin", "stex", "ctpk", "ctxb",
]
SKIP_EXTENSIONS = [
    "bcstm", "bcwav", "bcsnd", "bcsar", "wav", "ogg", "mp3", "aac",
    "moflex", "mp4", "mbm", "tbl", "bf", "sav", "txt", "xml", "lua",
]
ARCHIVE_EXTENSIONS = ["hpi", "hpb", "farc", "epl"]

# Magic -> suffix for unnamed members, two flavours.
FLAT_SUFFIXES = [
    ("STEX", ".stex"), ("FARC", ".farc"), ("SIR0", ".sir0"), ("CGFX", ".cgfx"), ("CTPK", ".ctpk"),
]
FLAT_EMBEDDED_SUFFIX = ".bchbin"
PACKAGE_SUFFIXES = [
    ("STEX", ".stex"), ("CGFX", ".cgfx"), ("BCH\0", ".bch"), ("ATBC", ".bam"), ("CTPK", ".ctpk"),
    ("CTXB", ".ctxb"), ("ctxb", ".ctxb"), ("FARC", ".farc"), ("EPL", ".epl"),
]
PACKAGE_SUFFIX_MAX = 12
DEFAULT_SUFFIX = ".bin"

# Issue stages that count as decoder issues.
COUNTABLE_STAGES = [
    "stex", "stex_decode", "stex_decode_error",
    "cgfx", "cgfx_model", "cgfx_decode_error", "cgfx_material_parse_error", "cgfx_material_texture_missing",
    "bch", "bch_model", "bch_decode_error", "bch_material_parse_error", "bch_material_texture_missing",
    "container_decode_error",
]
COUNTABLE_READ_STAGE = "romfs_read"       # counts unless the source is an archive
COUNTABLE_DECODE_STAGE = "texture_decode"  # counts only for the one extension below
COUNTABLE_DECODE_EXTENSION = "stex"

# Shader-stage bookkeeping.
TEXTURE_SOURCE_IDS = (3, 5)   # inclusive; slot = id - 3
PREVIOUS_SOURCE_ID = 15
MAX_OPERAND_ID = 7
SCALAR_OPERANDS = [0, 1]
COMBINER_ARITY = {0: 1, 1: 2, 2: 2, 3: 2, 5: 2, 4: 3, 8: 3, 9: 3}
CHANNEL_OPERANDS = [
    "Alpha", "OneMinusAlpha", "Red", "OneMinusRed", "Green", "OneMinusGreen", "Blue", "OneMinusBlue",
]
MATERIAL_SLOTS = [0, 1, 2]

# Extraction limits (two published default sets).
LIMITS_DEFAULT = {
    "max_depth": 16, "max_members": 250_000, "max_expanded_bytes": 32 << 30,
    "max_member_bytes": 2 << 30, "max_archive_bytes": 8 << 30,
}
LIMITS_STRICT = {
    "max_depth": 16, "max_members": 250_000, "max_expanded_bytes": 32 << 30,
    "max_member_bytes": 1 << 30, "max_archive_bytes": 4 << 30,
}

# Similarity acceptance and report limits.
NEAREST_BEST_MAX = 0.055
NEAREST_GAP_MIN = 0.012
NEAREST_SECOND_OK = 0.10
ASPECT_TOLERANCE = 0.02
REFERENCE_DISPLAY_LIMIT = 20
MAGIC_TOP = 50
PAGE_SIZE = 25
SAMPLE_MAX_FILES = 6
SAMPLE_MAX_BYTES = 32 * 1024 * 1024
SAMPLE_FIRST_RULE_QUOTA = 3
TOKEN_LIMIT_WIDE = 16
TOKEN_LIMIT_NARROW = 8
FINGERPRINT_SCHEMA = 1

# File-name shapes.
ASSET_NAME_PATTERN = r"(?i)^tex1_(\d+)x(\d+)_([0-9A-Fa-f]{8,16})_(\d+)(?:_mip(\d+))?\.png$"
ASSET_ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}$"
TITLE_ID_PATTERN = r"^[0-9A-Fa-f]{16}$"
HASH_PATTERN = r"^[0-9A-Fa-f]{1,16}$"
MASK_WORDS = ["mask", "opacity", "transparency", "trans"]
MASK_NAME_PATTERN = r"(^|[_\-.])(alpha|mask|opacity|trans|transparency)([_\-.]|$)"
MASK_SLUG_PATTERN = r"-(alpha|mask|opacity)($|-)"
MODEL_TAIL_PATTERN = r"-(a|b|model|mdl)$"
GENERIC_TEXTURE_TAIL = r"-(t|tex|texture|diff|diffuse|color|body)?0*1"
DEVICE_NAMES = r"(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])"
