from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
ODD_DOCS, LONG = _module.ODD_DOCS, _module.LONG
