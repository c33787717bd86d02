import sys

from crawlloom.plans.run import main

sys.exit(main())
