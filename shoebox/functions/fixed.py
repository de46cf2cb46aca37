"""Constants that results depend on, stated as they are."""

# Media-subtype bits of the public photo framework.
SUBTYPE_PANORAMA = 1
SUBTYPE_SCREENSHOT = 4
SUBTYPE_LIVE = 8
SUBTYPE_DEPTH = 16

# File-name marks of screen recordings (upper-cased names).
RECORDING_PREFIX = "RPREPLAY"
RECORDING_MARKS = ("SCREENRECORD", "屏幕录制")

# Source types that a catalog scan reads.
SCANNED_SOURCES = ("user_library", "cloud_shared", "itunes_synced")

# Image file extensions that a folder scan reads.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic")

# Size estimates when no exact size is known.
VIDEO_BITS_PER_SECOND = 9_000_000
IMAGE_BYTES_PER_PIXEL = 0.35

FINGERPRINT_VERSION = 8
EMBEDDING_REVISION = 2

# Phone screen sizes (short side, long side).
PHONE_SCREENS = (
    (640, 1136), (750, 1334), (828, 1792), (1125, 2436), (1170, 2532), (1179, 2556), (1206, 2622),
    (1242, 2208), (1242, 2688), (1260, 2736), (1284, 2778), (1290, 2796), (1320, 2868),
)
# Tablet and older screen sizes that ordinary photos share.
AMBIGUOUS_SCREENS = (
    (1024, 1366), (1032, 1376), (1080, 1920), (1440, 2560), (1488, 2266), (1536, 2048), (1620, 2160),
    (1640, 2360), (1668, 2388), (1668, 2420), (2048, 2732), (2064, 2752),
)

# The categories, those a learned head can predict, and those only it can predict.
CATEGORIES = (
    "duplicate", "screenshot", "chatScreenshot", "gameScreenshot", "documentShot", "webShot",
    "mapScreenshot", "systemScreenshot", "other", "screenRecording", "blurry", "largeVideo",
)
LEARNABLE = (
    "chatScreenshot", "gameScreenshot", "documentShot", "webShot",
    "mapScreenshot", "systemScreenshot", "screenshot", "other",
)
HEAD_ONLY = ("mapScreenshot", "webShot", "other")
NEVER_PROPOSED = ("documentShot",)

# Image-classifier labels that hint at a game or at a document.
GAME_LABELS = (
    "animation", "armor", "car_racing", "cartoon", "fantasy",
    "illustration", "spacecraft", "sword", "toy", "video_game",
)
DOCUMENT_LABELS = (
    "barcode", "book_jacket", "business_card", "document", "envelope", "menu",
    "paper", "qr_code", "receipt", "text", "ticket",
)

# Days of grace before a marked item is due.
GRACE_DAYS = {"immediate": 0, "oneDay": 1, "oneWeek": 7, "oneMonth": 30}

TIERS = {"identical": 0, "copy": 1, "moment": 2}
