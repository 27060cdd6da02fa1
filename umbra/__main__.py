"""python -m umbra."""

import sys

from umbra.cli import main

sys.exit(main())
