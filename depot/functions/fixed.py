"""Formats, names and small rule tables that results depend on.

Everything here is a published fact about a format or a compatibility rule; a
different value would give different answers, so they are stated as they are.
"""

# Leading numeric parts of a version. Anchored at the start only; a fourth part of
# any text is kept as "extra". [0-9] because Java and Python disagree on \d.
VERSION_PATTERN = r"^([0-9]+)(?:\.([0-9]+)(?:\.([0-9]+)(?:\.(.+))?)?)?"

# A digit starts a version.
VERSION_START_PATTERN = r"^[0-9]"

# Characters that end a line besides the newline ("\r\n" is one end), and blanks trimmed
# from the ends of a line besides the space.
LINE_ENDS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
RARE_BLANKS = "\t\u001f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANKS = " " + RARE_BLANKS

# Snapshot directory label and environment key.
SNAPSHOT_LABEL_PATTERN = r"^g([0-9]+)$"
LOCK_PATH_PATTERN = r"/g([0-9]+)/([^/]+)\.txt$"
ENV_PATTERN = r"^python(.+?)-torch(.+)-(cpu|cu[0-9]+)$"

# Artifact file names in the toolkit catalogs.
CUDA_FILE_PATTERN = r"^cuda_([^_]+)_([^_]+)_linux.run$"
CUDNN_FILE_PATTERN = r"^cudnn-linux-x86_64-([^_]+)_cuda([^-]+)-archive.tar.xz$"

# Hosts that serve presigned URLs, whose query part changes on every request.
PRESIGNED_HOSTS = [
    "cdn-lfs-us-1.hf.co",
    "cdn-lfs-eu-1.hf.co",
    "cdn-lfs.hf.co",
    "cas-bridge.xethub.hf.co",
]
PRESIGNED_HOST_PART = ".s3."
PRESIGNED_HOST_SUFFIX = ".amazonaws.com"

# Key of the URL in one row of the ranked feed.
FEED_URL_KEY = "cache.request.resolved_url"

# Names in a cache directory that are not cached objects.
CACHE_STATE_FILE = "metadata.json"

# Packages that may stay unpinned in a snapshot definition.
SEED_PACKAGES = ["cython", "pip", "packaging", "setuptools", "wheel"]

# Packages left out of the layer conflict report.
CONFLICT_EXCLUDED = ["hf-transfer"]

# Package indexes.
TORCH_INDEX = "https://download.pytorch.org/whl"
DEFAULT_INDEX = "https://pypi.org/simple"

# Torch major.minor -> Python range (inclusive) and accelerators it is built for.
TORCH_RULES = [
    ("2.7", "3.9", "3.13", ["cpu", "11.8", "12.6", "12.8"]),
    ("2.6", "3.9", "3.13", ["cpu", "11.8", "12.4", "12.6"]),
    ("2.5", "3.9", "3.12", ["cpu", "11.8", "12.1", "12.4"]),
    ("2.4", "3.8", "3.12", ["cpu", "11.8", "12.1", "12.4"]),
    ("2.3", "3.8", "3.11", ["cpu", "11.8", "12.1"]),
    ("2.2", "3.8", "3.11", ["cpu", "11.8", "12.1"]),
    ("2.1", "3.8", "3.11", ["cpu", "11.8", "12.1"]),
    ("2.0", "3.8", "3.11", ["cpu", "11.7", "11.8"]),
]
TORCH_RULES_COLUMNS = "version, python_min, python_max, cudas"

# Torch -> companion releases (torchaudio, torchvision).
TORCH_COMPANIONS = [
    ("2.7.1", "2.7.1", "0.22.1"),
    ("2.7.0", "2.7.0", "0.22.0"),
    ("2.6.0", "2.6.0", "0.21.0"),
    ("2.5.1", "2.5.1", "0.20.1"),
    ("2.5.0", "2.5.0", "0.20.0"),
    ("2.4.1", "2.4.1", "0.19.1"),
    ("2.4.0", "2.4.0", "0.19.0"),
    ("2.3.1", "2.3.1", "0.18.1"),
    ("2.3.0", "2.3.0", "0.18.0"),
    ("2.2.2", "2.2.2", "0.17.2"),
    ("2.2.1", "2.2.1", "0.17.1"),
    ("2.2.0", "2.2.0", "0.17.0"),
    ("2.1.2", "2.1.2", "0.16.2"),
    ("2.1.1", "2.1.1", "0.16.1"),
    ("2.1.0", "2.1.0", "0.16.0"),
    ("2.0.1", "2.0.2", "0.15.2"),
    ("2.0.0", "2.0.0", "0.15.0"),
]
TORCH_COMPANIONS_COLUMNS = "torch, torchaudio, torchvision"

# Requirements an environment needs below a torch version.
NUMPY_CAP_BELOW = "2.6.0"
NUMPY_CAP = "numpy<2.0.0"
CUDA_RUNTIME_BELOW = "2.2.0"
CUDA_RUNTIME_PACKAGES = [
    "nvidia-cublas",
    "nvidia-cuda-cupti",
    "nvidia-cuda-nvrtc",
    "nvidia-cuda-runtime",
    "nvidia-cudnn",
    "nvidia-cufft",
    "nvidia-curand",
    "nvidia-cusolver",
    "nvidia-cusparse",
    "nvidia-nccl",
    "nvidia-nvtx",
]
CUDA_12_PACKAGES = ["nvidia-nvjitlink"]

# Smallest file considered by the duplicate report (1 MiB) and cache defaults.
DUPLICATE_MIN_SIZE = 1024 * 1024
CACHE_BUDGET = 1024 * 1024 * 1024 * 1024
REFRESH_SECONDS = 24 * 60 * 60
