"""Training-data operators.  Nothing outside this folder imports it."""

import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
