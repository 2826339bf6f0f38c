"""Writers. These are the functions that start jobs."""
