"""weftline: context assembly, retrieval and evaluation as Spark DataFrame plans."""

import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # tasks share the cores; numpy's own threads would only wait for each other
    os.environ.setdefault(_name, "1")
