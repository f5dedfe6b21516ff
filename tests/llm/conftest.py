import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))  # test modules share their brute-force rules
