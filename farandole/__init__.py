"""Farandole: public-transport analytics and training-data operators on PySpark."""
