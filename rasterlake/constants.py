"""Thresholds of the engine, in one place. All are fixed values: results depend on them."""

# content classes
UNIQUE_CAP, MAX_SAMPLES = 4096, 200_000
FLAT_MIN_FLATNESS, FLAT_MAX_COLORS, BILEVEL_MIN_EXTREME = 0.45, 3072, 0.9
NEAR_BLACK, NEAR_WHITE = 40, 215
# structural similarity
SSIM_WINDOW, SSIM_C1, SSIM_C2, COMPARE_EDGE = 8, (0.01 * 255) ** 2, (0.03 * 255) ** 2, 512
SSIM_PRESETS = {"high": 0.99, "balanced": 0.98, "small": 0.965}
ANALYSE_EDGE = 1024
# lossy formats: quality bounds and steps of the searches
VISUAL_QUALITIES, VISUAL_STEPS, VERIFY_STEP, VERIFY_ATTEMPTS = (0.4, 0.96), 7, 0.04, 3
PRIMARY_QUALITY, READABLE_QUALITY, POOREST_QUALITY, SCALE_STEPS, IMAGE_LEAST_SCALE = 0.82, 0.35, 0.1, 6, 0.15
# palettes: bits kept of each channel
BITS = 5
PALETTE_SIZES = (256, 64, 32)
# images
MIN_DIMENSION, PROXY_MAX_PIXELS = 16, 1_200_000
SHRINK, SHRINK_ATTEMPTS = 0.82, 10
MIN_IMAGE_BYTES = 2048
# documents
MIN_LONG_EDGE, DPI_PRESETS, PAGE_MAX_EDGE = 220, (150, 300), 1600
ESTIMATE_MARGIN = 0.99
VISUAL_QUALITY, TARGET_QUALITY, LEAST_QUALITY, LEAST_SCALE = 0.88, 0.82, 0.3, 0.05
TARGET_SCALE_STEPS, TARGET_QUALITY_STEPS = 8, 6
BASE_SCALE_PAGES, BASE_SCALE, BASE_SCALE_LONG = 15, 1.5, 1.0

# fixed values: output formats and the names that go with them
FORMATS = {
    "jpeg": ("image/jpeg", "jpg", "JPG"),
    "png": ("image/png", "png", "PNG"),
    "webp": ("image/webp", "webp", "WebP"),
    "avif": ("image/avif", "avif", "AVIF"),
    "bmp": ("image/bmp", "bmp", "BMP"),
}
#: What can be written here; no WebP or AVIF encoder is available.
ENCODERS = {"png": True, "bmp": True, "jpeg": True, "webp": False, "avif": False}
