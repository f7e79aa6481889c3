"""Script to submit: ``spark-submit --py-files oddwire.zip oddwire_app.py application ...``."""

from oddwire.__main__ import main

if __name__ == "__main__":
    main()
