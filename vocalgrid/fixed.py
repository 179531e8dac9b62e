"""Names, codes, thresholds and rates that results depend on."""

# Frame rate assumed when a subject's metadata names none, and in the offset check.
DEFAULT_FPS = 83.28

# Quality tiers: lower bound of the correlation, best first; anything below is POOR.
QUALITY_TIERS = (
    ("EXCELLENT", 0.4),
    ("GOOD", 0.3),
    ("MODERATE", 0.2),
    ("ACCEPTABLE", 0.1),
)
LOWEST_TIER = "POOR"

# Least correlation for a valid alignment: library default and the batch job's value.
MIN_CORRELATION = 0.5
BATCH_MIN_CORRELATION = 0.3

# Share of the noise power that the batch job takes out of the audio.
NOISE_SHARE = 0.8

# Seconds of processing assumed per utterance in the progress report.
SECONDS_PER_UTTERANCE = 3.5

# Mask classes.
BACKGROUND, TONGUE, JAW, LIPS = 0, 1, 2, 3

# The geometric parameters in column order.
GEOMETRIC_FEATURES = (
    "tongue_area",
    "tongue_centroid_x",
    "tongue_centroid_y",
    "tongue_tip_y",
    "tongue_dorsum_height",
    "tongue_width",
    "jaw_area",
    "jaw_centroid_y",
    "jaw_opening",
    "lip_area",
    "lip_centroid_y",
    "lip_aperture",
    "constriction_degree",
    "constriction_location_y",
)

# Directories that are never subjects.
IGNORED_DIRECTORIES = ("__pycache__", "logs")

# Where a subject's images may lie, in order of preference: (pattern below the subject, folder, format).
IMAGE_LOCATIONS = (
    (r"^2drt/video/[^/]+\.(mp4|avi)$", "2drt/video", "video_dir"),
    (r"^[^/]+\.(mp4|avi|mov)$", "", "video_dir"),
    (r"^mri_frames/[^/]+\.(png|jpg)$", "mri_frames", "frames"),
    (r"^frames/[^/]+\.(png|jpg)$", "frames", "frames"),
    (r"^mri/[^/]+\.(png|jpg)$", "mri", "frames"),
    (r"^2drt/frames/[^/]+\.(png|jpg)$", "2drt/frames", "frames"),
)

# Metadata files, in order of preference.
METADATA_FILES = ("metadata.json", "info.json", "metadata.mat", "info.mat")

# File name endings that carry an utterance name, in order of preference.
UTTERANCE_FILE_PATTERNS = (r"([^/]+)_mel\.npy$", r"([^/]+)_params\.npy$")

# Recommended subjects: least video and audio signal-to-noise rating.
MIN_VIDEO_SNR = 4
MIN_AUDIO_SNR = 4

# Small constants that guard divisions.
SCALE_EPSILON = 1e-8
DICE_EPSILON = 1e-7
MEAN_EPSILON = 1e-9

# Decibel floor and range.
POWER_FLOOR = 1e-10
TOP_DB = 80.0
