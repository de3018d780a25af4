"""Training-data operators: ten corpus jobs, each a module, with their queries in ``queries``."""
