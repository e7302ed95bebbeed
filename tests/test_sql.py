from lotespark.functions import sql


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS) + 1
    got = spark.sql("SELECT lote_slug('Ñandú Várzea'), lote_money('15,673.60'), lote_dotted_decimal('1.234,5'), lote_zero_filled('30011', 15), lote_department('23'), lote_district_use('M2'), lote_vacancy(0.5, NULL), lote_house_number(1, 101, 0.235)").first()
    assert tuple(got) == ("nandu-varzea", 15673.6, 1234.5, "000000000030011", "Rivadavia", "mixto", "vacante", 24)
    assert spark.sql("SELECT * FROM lote_grid_cells(0.0D, 0.0D, 1.0D, 1.0D, 0.5D)").count() == 4
    assert abs(spark.sql("SELECT lote_metres(0, 0, 0, 1)").first()[0] - 111195) < 1
