from __future__ import annotations

import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import os  # noqa: E402

# Python workers find the package however the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join([str(pathlib.Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])
