import sys

from evidra.cli import main

sys.exit(main())
