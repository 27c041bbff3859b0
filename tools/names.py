"""Names of the queries registered in one catalog module: python tools/names.py move_queries"""
import re
import sys
from pathlib import Path

src = Path(__file__).resolve().parent.parent / "squareframe" / "plans" / f"{sys.argv[1]}.py"
print(" ".join(re.findall(r'@register\(\s*"([a-z0-9_]+)"', src.read_text())))
