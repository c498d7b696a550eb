"""Reading raw images and writing what is recovered."""
