"""Declared schemas of the tables the library reads and writes."""
from __future__ import annotations

POINT = "struct<x:double,y:double>"
GEOM = f"struct<type:string,polys:array<array<array<{POINT}>>>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

BUILDINGS = f"id string, geometry binary, bbox {BBOX}"
ROADS = f"id string, subtype string, geometry binary, bbox {BBOX}"
POIS = (
    "id string, names struct<primary:string>, categories struct<main:string>, "
    f"confidence double, geometry binary, bbox {BBOX}"
)
CITY_REGISTRY = "city string, image_path string, labels_path string, use_augmentation boolean"
PREDICTION = f"geom {GEOM}, city string, country string"
METRIC = "city string, f1 double, precision double, recall double, num_tiles long"
POPULATION = (
    "country string, city string, total_population double, informal_population double, "
    "proportion_informal double, dataset_used string"
)
MORPHOMETRIC = (
    "tessellation_car double, buildings_wall double, buildings_adjacency double, "
    "buildings_neighbour_distance double, city string"
)
# one line of a GeoJSON file, coordinates left as text until the geometry type is known
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
