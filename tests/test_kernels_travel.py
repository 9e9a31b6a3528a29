"""Executors do not have the package: every function sent to them must load without it."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from offramp.functions.kernels import kl_kernel, logit_summary, token_encoder
from offramp.operators.head_blocks import _block_scorer
from offramp.operators.ordering import _points
from offramp.streaming.jobs import _ending


def _functions():
    return {"kl_kernel": kl_kernel.func, "logit_summary": logit_summary.func,
            "token_encoder": token_encoder(["a"], [1], 0).func,
            "block_scorer": _block_scorer(None, None, 1e-6, None), "points": _points(3), "ending": _ending(10, 0)}


@pytest.mark.parametrize("name", ["kl_kernel", "logit_summary", "token_encoder", "block_scorer", "points", "ending"])
def test_loads_without_the_package(spark, tmp_path, name):
    (tmp_path / "fn").write_bytes(cloudpickle.dumps(_functions()[name]))
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(open('fn', 'rb').read()); " \
           "assert callable(f) and 'offramp' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
